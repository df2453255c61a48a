"""Aggregation operators. All are ``groupBy().agg()`` plans, so Spark runs a partial
(map-side) aggregate before the shuffle: a group holding a third of the rows costs one
partial row per task, not a third of the data in one task."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_count(df: DataFrame, key: str, key_alias: str, count_alias: str = "total", **extra: Column) -> DataFrame:
    """Rows per ``key`` (caller pages it by count DESC, key ASC), with further aggregates if given."""
    return df.groupBy(F.col(key).alias(key_alias)).agg(
        F.count(F.lit(1)).alias(count_alias), *[c.alias(name) for name, c in extra.items()])


def with_total(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column],
               label_col: str, label: str, blank_on_total: Mapping[str, Column] | None = None) -> DataFrame:
    """Detail groups plus one grand-total row over all groups, in one aggregation.

    Grouping sets ``(keys), ()`` compute both levels from one partial aggregate; the total row
    carries ``label`` in ``label_col`` and ``row_kind = 'total'``. Columns listed in
    ``blank_on_total`` take the given value on the total row (e.g. NULL day counts).
    """
    agg_cols = [v.alias(k) for k, v in aggs.items()]
    grouped = df.groupingSets([list(keys), []], *keys).agg(*agg_cols, F.grouping_id().alias("_gid"))
    is_total = F.col("_gid") != 0
    out = grouped.withColumn(label_col, F.when(is_total, F.lit(label)).otherwise(F.col(label_col)))
    for name, value in (blank_on_total or {}).items():
        out = out.withColumn(name, F.when(is_total, value).otherwise(F.col(name)))
    return out.withColumn("row_kind", F.when(is_total, F.lit("total")).otherwise(F.lit("detail"))).drop("_gid")


def distinct_text(col: str | Column, sep: str = ", ") -> Column:
    """Distinct values as text, sorted as text (``1, 10, 2``), joined by ``sep``.

    The set is per group and bounded by the column's domain (months, resorts).
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), sep)


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Σ(value × weight) ÷ Σ weight, NULL unless the weights sum to more than 0.

    The sums keep the input types (exact for decimal values and integer weights, so the order in
    which tasks add them does not matter); the one division is done in double precision."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    total_w = F.sum(w)
    return F.when(total_w > 0, F.sum(v * w).cast("double") / total_w.cast("double"))
