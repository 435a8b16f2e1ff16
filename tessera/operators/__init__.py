from tessera.operators.aggregates import avg, count, global_aggregate, group_by, max_, ndv, ndv_exact, ndv_merged, ndv_sketch, sum_, top_group
from tessera.operators.joins import hash_join
from tessera.operators.relational import compute, project, where
from tessera.operators.skyline import pareto
from tessera.operators.sorting import deep_page, merge_runs, offset_value_code, page, sort, top_k

__all__ = ["avg", "compute", "count", "deep_page", "global_aggregate", "group_by", "hash_join", "max_", "merge_runs", "ndv", "ndv_exact", "ndv_merged", "ndv_sketch",
           "offset_value_code", "page", "pareto", "project", "sort", "sum_", "top_group", "top_k", "where"]
