"""Column expressions shared by the operators; all stay in the JVM."""

from barline.functions.columns import (
    arr_last,
    clip_below,
    epoch_ms,
    inf_to_null,
    month_end,
    nearest_minute,
    null_count,
    pct_change,
    safe_div,
    stable_round,
    truncated,
    week_end,
    week_start,
    zero_to_null,
)
from barline.functions.ranks import average_rank, dense_rank_desc, guarded_rank, pct_rank, quantile_bin, row_rank, sql_percent_rank

__all__ = [
    "arr_last", "average_rank", "clip_below", "dense_rank_desc", "epoch_ms", "guarded_rank", "inf_to_null", "month_end",
    "nearest_minute", "null_count", "pct_change", "pct_rank", "quantile_bin", "row_rank", "safe_div", "sql_percent_rank", "stable_round", "truncated",
    "week_end", "week_start", "zero_to_null",
]
