"""Filter resolution (driver side, values only) and predicate builders (Catalyst columns).

A request arrives as a ``dict[str, str]``. :class:`Filters` normalises its keys, applies a
per-analysis alias table and parses values once; the predicate builders turn the parsed values
into ``Column`` expressions that Catalyst pushes to the scan where it can. Folded comparisons use
the ``<col>__key`` twin written at ingest when the table has one, so they reach Parquet as plain
equality; otherwise the fold is computed in the projection (still codegen, no Python).
"""

from __future__ import annotations

from functools import reduce
from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType, StringType

from innsight.errors import AnalysisError
from innsight.functions.text import ALL_RESORTS, canonical_code_py, fold, fold_py, month_number_py

KEY_SUFFIX = "__key"


def norm_key(key: str) -> str:
    """Filter-name normal form: folded, with spaces and underscores left out."""
    return "".join(c for c in fold_py(key or "") if c != "_" and not c.isspace())


def _blank(v: Any) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


class Filters:
    """Normalised view of a request's filters.

    ``aliases`` maps a normalised API key to the canonical key (e.g. ``resort → hotel``). When
    two API keys land on one canonical key the first non-blank value wins.
    """

    def __init__(self, raw: Mapping[str, Any] | None, aliases: Mapping[str, str] | None = None):
        aliases = aliases or {}
        self._values: dict[str, Any] = {}
        for k, v in (raw or {}).items():
            nk = norm_key(str(k))
            ck = aliases.get(nk, nk)
            if _blank(self._values.get(ck)):
                self._values[ck] = v

    def raw(self, *keys: str) -> Any:
        for k in keys:
            v = self._values.get(norm_key(k))
            if not _blank(v):
                return v
        return None

    def has(self, *keys: str) -> bool:
        return self.raw(*keys) is not None

    def text(self, *keys: str) -> str | None:
        v = self.raw(*keys)
        return None if v is None else str(v).strip()

    def integer(self, *keys: str) -> int | None:
        v = self.raw(*keys)
        if v is None:
            return None
        try:
            return int(str(v).strip())
        except ValueError:
            raise AnalysisError(f"filter {keys[0]!r} must be an integer, got {v!r}") from None

    def month(self, *keys: str) -> int | None:
        v = self.raw(*keys)
        if v is None:
            return None
        m = month_number_py(str(v))
        if not isinstance(m, int):
            raise AnalysisError(f"filter {keys[0]!r} is not a month: {v!r}")
        return m

    def items(self, *keys: str) -> list[str]:
        """Comma-separated list, items trimmed, blanks dropped, order kept, duplicates removed."""
        v = self.raw(*keys)
        if v is None:
            return []
        parts = v if isinstance(v, (list, tuple)) else str(v).split(",")
        return list(dict.fromkeys(str(p).strip() for p in parts if str(p).strip()))

    def months(self, *keys: str) -> list[int]:
        out = []
        for item in self.items(*keys):
            m = month_number_py(item)
            if not isinstance(m, int):
                raise AnalysisError(f"filter {keys[0]!r} holds a non-month {item!r}")
            out.append(m)
        return list(dict.fromkeys(out))

    def resort(self, *keys: str, codes: tuple[str, ...] | None = None) -> str | None:
        """Canonical resort code when the value contains one (``all_resorts`` included)."""
        v = self.text(*keys)
        if v is None:
            return None
        return canonical_code_py(v) if codes is None else canonical_code_py(v, codes)

    def resorts(self, *keys: str) -> list[str]:
        return list(dict.fromkeys(canonical_code_py(v) for v in self.items(*keys)))

    def require(self, **named: Any) -> None:
        missing = [k for k, v in named.items() if v is None or v == [] or v == ""]
        if missing:
            raise AnalysisError("required filters missing: " + ", ".join(missing))


def is_all(resort: str | None) -> bool:
    return resort is None or fold_py(resort) == ALL_RESORTS


# --- predicate builders -----------------------------------------------------------------------

def folded(df: DataFrame, col: str) -> Column:
    """Folded form of ``col``: the ingest-time ``__key`` twin when present, else computed. (Ingested cells
    are trimmed, so the twin is the trimmed form as well.)"""
    twin = col + KEY_SUFFIX
    return F.col(twin) if twin in df.columns else fold(col)


def trim_folded(df: DataFrame, col: str) -> Column:
    """Trimmed folded form of ``col``: the bare twin when present, so that a comparison reaches the scan."""
    return F.col(col + KEY_SUFFIX) if col + KEY_SUFFIX in df.columns else F.trim(fold(col))


def fold_eq(df: DataFrame, col: str, value: Any) -> Column:
    """``unaccent(lower(col)) = unaccent(lower(value))``."""
    return folded(df, col) == F.lit(fold_py(str(value)))


MOST_MATCHES = 500  # values of a membership that stands for a contains


def _matching(df: DataFrame | None, col: str | Column, needle: str, domains: Mapping[str, Sequence[str]] | None) -> Column | None:
    """Contains as membership of the twin in its values that hold ``needle``: it reaches the scan, where min/max statistics
    and dictionaries skip row groups. None where the values are not known or too many match."""
    twin = f"{col}{KEY_SUFFIX}" if isinstance(col, str) else None
    if df is None or twin not in df.columns or twin not in (domains or {}):
        return None
    values = [v for v in domains[twin] if needle in v]
    return F.col(twin).isin(values) if 0 < len(values) <= MOST_MATCHES else None if values else F.lit(False)


def fold_contains(col: str | Column, value: Any, wildcard: bool = False, df: DataFrame | None = None,
                  domains: Mapping[str, Sequence[str]] | None = None) -> Column:
    """accent/case-insensitive contains; ``wildcard`` keeps ``%``/``_`` as LIKE wildcards. With ``df`` the
    twin of its column is searched where it has one; with the ``domains`` of its table (twin → all values) as membership."""
    if not wildcard and (member := _matching(df, col, fold_py(str(value)), domains)) is not None:
        return member
    c = folded(df, col) if df is not None else fold(col)
    v = fold_py(str(value))
    return c.like(f"%{v}%") if wildcard else c.contains(F.lit(v))


def trim_fold_contains(col: str, value: Any, df: DataFrame | None = None,
                       domains: Mapping[str, Sequence[str]] | None = None) -> Column:
    """``trim(fold(col))`` contains ``fold(value)``; with ``df`` on the twin where there is one, with ``domains`` as membership."""
    if (member := _matching(df, col, fold_py(str(value)), domains)) is not None:
        return member
    c = trim_folded(df, col) if df is not None else F.trim(fold(col))
    return c.contains(F.lit(fold_py(str(value))))


def trim_fold_eq(df: DataFrame, col: str, value: Any) -> Column:
    """equality of trimmed folded forms on both sides."""
    return trim_folded(df, col) == F.lit(fold_py(str(value)).strip())


def typed_literal(df: DataFrame, col: str, value: Any) -> Column:
    """The value as a literal of the column's type; a bad value raises before any job."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, IntegralType):
        try:
            return F.lit(int(str(value).strip())).cast(dtype)
        except ValueError:
            raise AnalysisError(f"{col} expects an integer, got {value!r}") from None
    if isinstance(dtype, NumericType):
        try:
            return F.lit(float(str(value).strip().replace(",", "."))).cast(dtype)
        except ValueError:
            raise AnalysisError(f"{col} expects a number, got {value!r}") from None
    if isinstance(dtype, StringType):
        return F.lit(str(value))
    return F.lit(value).cast(dtype)


def eq(df: DataFrame, col: str, value: Any) -> Column:
    """exact equality with the literal cast to the column's type."""
    return F.col(col) == typed_literal(df, col, value)


def int_eq(df: DataFrame, col: str, value: int) -> Column:
    """equality after an integer cast of the column (text months such as ``07`` match 7)."""
    if isinstance(df.schema[col].dataType, IntegralType):
        return F.col(col) == F.lit(int(value))
    return F.col(col).try_cast("int") == F.lit(int(value))


def int_in(df: DataFrame, col: str, values: Sequence[int]) -> Column:
    """F7 on an integer-cast column."""
    c = F.col(col) if isinstance(df.schema[col].dataType, IntegralType) else F.col(col).try_cast("int")
    return c.isin([int(v) for v in values])


def fold_in(df: DataFrame, col: str, values: Iterable[Any]) -> Column:
    """F8: folded membership; both sides folded."""
    return folded(df, col).isin([fold_py(str(v)) for v in values])


def at_least(col: str, bound: float) -> Column:
    """F9 lower bound on the column rounded to an integer (``::integer`` rounds)."""
    return F.round(F.col(col).cast("double")).cast("bigint") >= F.lit(bound)


def at_most(col: str, bound: float) -> Column:
    return F.round(F.col(col).cast("double")).cast("bigint") <= F.lit(bound)


def not_blank(col: str) -> Column:
    """not null and not the empty string."""
    return F.col(col).isNotNull() & (F.col(col) != F.lit(""))


def all_of(preds: Iterable[Column | None]) -> Column | None:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def where(df: DataFrame, preds: Iterable[Column | None]) -> DataFrame:
    cond = all_of(preds)
    return df if cond is None else df.where(cond)


def resort_pred(df: DataFrame, col: str, resort: str | None) -> Column | None:
    """F1 on the resort column, omitted for the ``all_resorts`` sentinel (F15) or no value."""
    return None if is_all(resort) else fold_eq(df, col, resort)
