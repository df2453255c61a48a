"""Ranking: row number within a partition, top-k kept.

``row_number() <= k`` over a window is planned with ``WindowGroupLimit`` before the window's
shuffle sort, so each task forwards at most ``k`` rows per partition key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.operators.listing import order_keys


def top_rank(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str | Column, str]],
             k: int, rank_col: str = "rank_num") -> DataFrame:
    """W1 + L4: ``row_number`` per partition in ``order``; rows with rank <= k."""
    w = Window.partitionBy(*partition).orderBy(*order_keys(order))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
