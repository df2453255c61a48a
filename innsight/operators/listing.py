"""Listing operators: projection and rename, explicit null ordering, paging, page statistics.

Paging is ``orderBy(...).offset(m).limit(n)``, which Spark plans as ``TakeOrderedAndProject``:
each task keeps only its best ``m + n`` rows, so a page never needs a global sort or a
collection of the filtered set. A page that continues from a token of the one before has no offset:
its rows are those behind the token's sort keys, and each task keeps its best ``n``.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.functions.text import snake_name
from innsight.operators.combine import with_scalars
from innsight.plans.spec import AnalysisResult, Listing, Page, token_keys


def order_keys(spec: Sequence[tuple[str | Column, str]]) -> list[Column]:
    """Sort columns with the null placement of the analysed system: ASC → NULLS LAST,
    DESC → NULLS FIRST (Spark's defaults are the reverse, so it is always explicit)."""
    out = []
    for col, direction in spec:
        c = F.col(col) if isinstance(col, str) else col
        out.append(c.desc_nulls_first() if direction.lower() == "desc" else c.asc_nulls_last())
    return out


def behind(df: DataFrame, order: Sequence[tuple[str | Column, str]], keys: Sequence[str | None]) -> Column:
    """Whether a row comes strictly after the row with these sort keys (as text), nulls placed as by :func:`order_keys`:
    equal in the first columns and behind in the next one, for any number of first columns."""
    found, equal = F.lit(False), F.lit(True)
    for (col, direction), key in zip(order, keys):
        c = F.col(col) if isinstance(col, str) else col
        value = F.lit(key).cast(df.select(c).schema[0].dataType)
        if direction.lower() == "desc":
            later = c.isNotNull() if key is None else F.coalesce(c < value, F.lit(False))
        else:
            later = F.lit(False) if key is None else c.isNull() | (c > value)
        found = found | (equal & later)
        equal = equal & c.eqNullSafe(value)
    return found


def page(df: DataFrame, order: Sequence[tuple[str | Column, str]], pg: Page) -> DataFrame:
    """L3: one page of ``df`` in ``order``, which must end with a unique tie-breaker (``id`` of published tables, or a group
    key): rows equal in all sort keys could not be told apart by a token."""
    if pg.after:
        df = df.where(behind(df, order, token_keys(pg.after, len(order))))
    ordered = df.orderBy(*order_keys(order))
    if pg.offset:
        ordered = ordered.offset(pg.offset)
    return ordered.limit(pg.limit)


def rename(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str] | None = None,
           extra: Sequence[Column] = ()) -> DataFrame:
    """Rename by map (case-insensitive source names) with snake-case fallback.

    ``keep`` restricts and orders the output (P2); ``__key`` twins never leak into output. ``extra`` columns follow.
    """
    cols = list(keep) if keep is not None else [c for c in df.columns if not c.endswith(("__key", "__date"))]
    lowered = {k.lower(): v for k, v in mapping.items()}
    return df.select(*[F.col(c).alias(lowered.get(c.lower(), snake_name(c))) for c in cols], *extra)


def iso_date(c: str | Column) -> Column:
    """ISO ``yyyy-MM-dd`` text of a date, timestamp or ISO-prefixed text value."""
    col = F.col(c) if isinstance(c, str) else c
    return F.substring(col.cast("string"), 1, 10)


def stats_of(date_col: str | Column | None = None) -> dict[str, Column]:
    """The aggregates of a listing: number of rows and freshness."""
    until = F.lit(None).cast("string") if date_col is None else iso_date(F.max(date_col))
    return {"total_records": F.count(F.lit(1)), "data_until": until}


def page_stats(df: DataFrame, date_col: str | Column | None = None, **extra: Column) -> DataFrame:
    """Total count and freshness of a filtered set in one aggregate job."""
    return df.agg(*[v.alias(k) for k, v in {**stats_of(date_col), **extra}.items()])


def listing(filtered: DataFrame, order: Sequence[tuple[str | Column, str]], pg: Page, shown,
            date_col: str | Column | None = None, repeated: Sequence[str] = ()) -> AnalysisResult:
    """A page of ``filtered`` with its statistics (A16, P8, K6). ``rows`` and ``stats`` are lazy frames of their own;
    the envelope takes both from one pass. ``shown(page, *extra)`` projects a page; ``repeated`` names statistics
    that stand on every row (in ``rows`` as a scalar subquery)."""
    metrics = {name: c for name, c in stats_of(date_col).items() if name != "data_until" or date_col is not None}
    stats = page_stats(filtered, date_col)
    rows = shown(page(filtered, order, pg))
    if repeated:
        rows = with_scalars(rows, stats.select(*repeated))
    return AnalysisResult(rows, stats, pg, listing=Listing(filtered, lambda df: page(df, order, pg), shown, metrics, tuple(repeated)),
                          order=tuple(order))
