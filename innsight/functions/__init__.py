"""Column functions (all built-in Catalyst expressions)."""

from innsight.functions.numeric import money, percent_columns, round_value, safe_ratio
from innsight.functions.text import (
    ALL_RESORTS, MONTH_NUMBERS, RESORT_CODES, canonical_code, canonical_code_py, fold,
    fold_py, month_number, month_number_py, snake_name,
)

__all__ = [
    "ALL_RESORTS", "MONTH_NUMBERS", "RESORT_CODES", "canonical_code", "canonical_code_py",
    "fold", "fold_py", "money", "round_value", "month_number", "month_number_py", "percent_columns",
    "safe_ratio", "snake_name",
]
