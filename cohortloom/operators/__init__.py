"""Reusable DataFrame operators."""

from .groups import (
    counts,
    drop_incomplete,
    exclude,
    fill_where,
    freq,
    headcount,
    per_entity_then,
    share,
    with_overall_mean,
)
from .joins import anti_join, attach_crosswalk, left_join, stack_sources
from .links import Link
from .ordering import sort_columns
from .quantiles import box_outliers, box_stats, order_statistics, quantiles
from .rows import (
    first_event,
    first_row,
    is_duplicate,
    last_event,
    slice_range,
    top_k,
    with_group_max,
    with_sort_rank,
)
from .smooth import loess
from .stats import logit_residuals, logit_summary, t_test

__all__ = [
    "Link", "anti_join", "attach_crosswalk", "box_outliers", "box_stats", "counts", "drop_incomplete",
    "exclude", "fill_where", "first_event", "first_row", "freq", "headcount", "is_duplicate",
    "last_event", "left_join", "loess", "logit_residuals", "logit_summary", "order_statistics", "per_entity_then",
    "quantiles", "share", "slice_range", "sort_columns", "stack_sources", "t_test", "top_k",
    "with_group_max", "with_overall_mean", "with_sort_rank",
]
