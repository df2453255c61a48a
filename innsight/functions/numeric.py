"""Numeric column helpers: guarded ratios, percent scaling and presentation rounding.

ANSI mode is on, so a bare ``/`` by zero raises; every ratio goes through :func:`safe_ratio`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_value(c: str | Column, digits: int = 2) -> Column:
    """Round a double by its exact binary value, ties to even, as Python's ``round`` does: 2.675 is
    2.67499… and gives 2.67, 0.125 is a tie and gives 0.12.

    ``x * 10**digits`` is rounded by the hardware, so its error is computed as well (the product of
    two doubles as an unevaluated sum, with ``x`` split in two halves); the error decides where the
    rounded product lies on the half. From 2^52 on the product is whole and the fraction lies in the error alone. Values whose
    neighbours are farther apart than the last digit, infinities and NaN are returned unchanged: no rounding changes them.
    """
    x = _col(c).cast("double")
    p = F.lit(float(10 ** digits))
    a = F.abs(x)
    product = a * p
    split = a * F.lit(134217729.0)           # 2^27 + 1
    high = split - (split - a)
    error = (high * p - product) + (a - high) * p
    spacing = 52 - math.floor(digits * math.log2(10))  # from 2^spacing on, neighbours are more than one digit apart
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    odd = whole % 2 == 1
    step = F.when(up | ((part == 0) & (error == 0.5) & odd), 1).when((part == 0) & (error == -0.5) & odd, -1).otherwise(0)
    rounded = (whole + step).cast("double") / p
    return F.when(a < float(2 ** spacing), F.when(x < 0, -rounded).otherwise(rounded)).otherwise(x)


def safe_ratio(num: str | Column, den: str | Column, scale: float = 100.0, digits: int = 2,
               when_zero: float = 0.0) -> Column:
    """``round(num / den * scale, digits)`` when ``den > 0``, else ``when_zero``."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.when(d > 0, round_value(n / d * F.lit(scale), digits)).otherwise(F.lit(float(when_zero)))


def percent_columns(df, columns):
    """Scale rate columns by 100 (2 decimals) where the column is numeric in the schema."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    return df.withColumns({c: round_value(F.col(c) * 100, 2) for c in columns if c in numeric})


def money(c: str | Column) -> Column:
    """P5 of an exact amount: null → 0, two decimals, ties to even in decimal arithmetic, as double (one
    numeric type for presentation). Amounts have at most four decimals (``decimal(38,4)``)."""
    return F.bround(F.coalesce(_col(c).cast("decimal(38,4)"), F.lit(0).cast("decimal(38,4)")), 2).cast("double")
