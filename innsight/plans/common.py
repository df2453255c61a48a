"""Small pieces shared by the analysis specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.operators.combine import with_scalars

from innsight.operators.listing import iso_date


DATE_SUFFIX = "__date"
DERIVED_SUFFIXES = ("__key", DATE_SUFFIX)


def date_col(df: DataFrame, name: str) -> str:
    """The typed twin ``<name>__date`` when the table has one (ingest adds it), else ``name``."""
    return name + DATE_SUFFIX if name + DATE_SUFFIX in df.columns else name


def source_columns(df: DataFrame) -> list[str]:
    """Columns of a ``SELECT *`` listing: everything but the derived ``__key``/``__date`` twins."""
    return [c for c in df.columns if not c.endswith(DERIVED_SUFFIXES)]


def max_iso(df: DataFrame, name: str) -> Column:
    """Aggregate: ISO text of the latest value of a date column."""
    return iso_date(F.max(date_col(df, name)))


def attach(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Repeat the columns of a one-row aggregate on every row (a scalar subquery, no join)."""
    return with_scalars(rows, one_row)
