"""Join operators. Every join here is between *aggregated* sides (one row per key), so the
inputs are already reduced by partial aggregation before any shuffle; the raw fact tables are
never joined row by row. Broadcast decisions are left to AQE, which only broadcasts a side whose
measured runtime size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_balance(left: DataFrame, right: DataFrame, key: str | Sequence[str],
                 left_measures: Sequence[str], right_measures: Sequence[str],
                 carry: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Full outer equi-join of two pre-aggregated sides; a missing side counts 0.

    NULL keys never match each other (both rows are kept), as in SQL. ``carry`` lists
    non-key columns present on both sides that are merged with ``coalesce(left, right)``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    l, r = left.alias("l"), right.alias("r")
    cond = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    joined = l.join(r, cond, "full_outer")
    cols = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    for name, (lc, rc) in (carry or {}).items():
        cols.append(F.coalesce(F.col(f"l.{lc}"), F.col(f"r.{rc}")).alias(name))
    cols += [F.coalesce(F.col(f"l.{m}"), F.lit(0)).alias(m) for m in left_measures]
    cols += [F.coalesce(F.col(f"r.{m}"), F.lit(0)).alias(m) for m in right_measures]
    return joined.select(*cols)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row of ``df``.

    The aggregate becomes a scalar subquery (packed in one struct): Spark evaluates it once and
    hands its single value to the tasks, so there is no join and no product. A subquery that
    returned more than one row would fail the query, which guards the one-row assumption."""
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_one")).scalar()
    return df.select("*", packed.alias("_one")) \
        .select(*[F.col(c) for c in df.columns], *[F.col("_one").getField(c).alias(c) for c in one_row.columns])


def scalar_ratio(*one_row_frames: DataFrame) -> DataFrame:
    """Combine independent one-row aggregates into one row (each further aggregate is a
    scalar subquery of the first; no join)."""
    out = one_row_frames[0]
    for f in one_row_frames[1:]:
        out = with_scalars(out, f)
    return out


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str],
                 label_col: str, value_col: str) -> DataFrame:
    """Unpivot ``columns`` (source column → label) into (label_col, value_col) rows."""
    renamed = df.select(*ids, *[F.col(src).alias(label) for src, label in columns.items()])
    return renamed.unpivot(list(ids), list(columns.values()), label_col, value_col)


def segment_join(wide: DataFrame, long: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a wide-to-long segment table to per-segment facts on shared keys."""
    return long.join(wide, list(on), how)
