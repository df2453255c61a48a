"""Output shapes: month pivot, nested indicator map, long form."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_pivot(df: DataFrame, keys: Sequence[str], month_col: str, months: Sequence[int],
                agg: Column, prefix: str = "month_", fill=None) -> DataFrame:
    """One column per month (``<prefix><m>``); months are an argument, so the output schema
    is known before execution (no distinct-values job). Months without rows are NULL, or
    ``fill`` when given. Spark aggregates per (keys, month) with a partial aggregate before the
    shuffle and only then spreads the months into columns."""
    months = list(months)
    out = df.groupBy(*keys).pivot(month_col, months).agg(agg)
    renamed = out.select(*keys, *[F.col(str(m)).alias(f"{prefix}{m}") for m in months])
    return renamed.fillna(fill, subset=[f"{prefix}{m}" for m in months]) if fill is not None else renamed


def nest_pairs(pairs: Sequence[str] | Mapping[str, tuple[str | None, str | None]]) -> Column:
    """``map(name → struct(actual, target))`` from (actual, target) columns, by default
    ``<name>_actual``/``<name>_target``; a column given as None is NULL."""
    if not isinstance(pairs, Mapping):
        pairs = {name: (name + "_actual", name + "_target") for name in pairs}

    def value(column: str | None) -> Column:
        return F.lit(None).cast("double") if column is None else F.col(column)
    entries = [x for name, (actual, target) in pairs.items() for x in (
        F.lit(name), F.struct(value(actual).alias("actual"), value(target).alias("target")))]
    return F.create_map(*entries) if entries else F.create_map().cast("map<string,struct<actual:double,target:double>>")


def explode_pairs(df: DataFrame, map_col: str, keep: Sequence[str]) -> DataFrame:
    """Long form of a nested pair map: one row per (…keep, indicator, actual, target)."""
    exploded = df.select(*keep, F.explode(map_col).alias("indicator", "_v"))
    return exploded.select(*keep, "indicator", F.col("_v.actual").alias("actual"),
                           F.col("_v.target").alias("target"))
