"""DataFrame-level operators."""

from rowloom.operators.aggregate import (
    aggregate_by,
    attach_group_aggregates,
    column_bounds,
    count_of,
    distinct_from_categories,
    distinct_of,
    mean_of,
    shape_report,
    share_of,
    sum_of,
)
from rowloom.operators.encode import (
    category_share_long,
    fit_categories,
    fit_categories_of,
    one_hot,
)
from rowloom.operators.filters import check_ids, drop_category, lookup
from rowloom.operators.joins import (
    Requested,
    inner_join,
    keep_requested,
    left_join_zero_fill,
    lookup_join,
    unknown_requests,
)
from rowloom.operators.narrow import memory_report, narrow, narrow_types
from rowloom.operators.rollup import rollup_child
from rowloom.operators.scale import (
    ScaleParams,
    exact_medians,
    fit_impute_scale,
    impute_scale,
)
from rowloom.operators.select import (
    cast_to_category,
    drop_columns,
    peek,
    prefix_columns,
    rename_columns,
    select_named,
    split_label,
    with_derived,
)
from rowloom.operators.sketch import (
    DistinctState,
    approx_medians,
    distinct_error,
    merge_quantiles,
    quantile_sketches,
    quantiles,
    rank_error,
)
from rowloom.operators.sparse import category_index, one_hot_long, one_hot_sparse, sparse_dot
from rowloom.operators.state import RollupState

__all__ = [
    "DistinctState",
    "Requested",
    "RollupState",
    "ScaleParams",
    "aggregate_by",
    "approx_medians",
    "attach_group_aggregates",
    "cast_to_category",
    "category_index",
    "category_share_long",
    "check_ids",
    "column_bounds",
    "count_of",
    "distinct_error",
    "distinct_from_categories",
    "distinct_of",
    "drop_category",
    "drop_columns",
    "exact_medians",
    "fit_categories",
    "fit_categories_of",
    "fit_impute_scale",
    "impute_scale",
    "inner_join",
    "keep_requested",
    "left_join_zero_fill",
    "lookup",
    "lookup_join",
    "mean_of",
    "memory_report",
    "merge_quantiles",
    "narrow",
    "narrow_types",
    "one_hot",
    "one_hot_long",
    "one_hot_sparse",
    "peek",
    "prefix_columns",
    "quantile_sketches",
    "quantiles",
    "rank_error",
    "rename_columns",
    "rollup_child",
    "select_named",
    "shape_report",
    "share_of",
    "sparse_dot",
    "split_label",
    "sum_of",
    "unknown_requests",
    "with_derived",
]
