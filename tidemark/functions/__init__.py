"""Column-level functions (all built-in Spark expressions, no Python UDFs)."""

from tidemark.functions.columns import pct_of, ratio_pct, require_columns, stage_index
from tidemark.functions.periods import (
    month_start,
    normalize_freq,
    period_index,
    period_label,
    period_start,
)
from tidemark.functions.rounding import round_even, round_sql

__all__ = [
    "month_start", "normalize_freq", "pct_of", "period_index", "period_label",
    "period_start", "ratio_pct", "require_columns", "round_even", "round_sql",
    "stage_index",
]
