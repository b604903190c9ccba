"""DataFrame -> DataFrame operators: funnels, cohorts, RFM, audit, overview."""

from tidemark.operators.cohort import cohort_counts, cohort_matrix, cohort_matrix_freq, cohort_retention
from tidemark.operators.distinct import (
    count_states,
    distinct_counts,
    distinct_rollup,
    distinct_states,
    merge_states,
)
from tidemark.operators.funnel import (
    DEFAULT_STAGES,
    densify_stages,
    funnel_all,
    funnel_by_segment,
    funnel_rates,
    funnel_reach,
    funnel_segment,
    funnel_unordered,
)
from tidemark.operators.ntile import global_ntile, ntile_columns, ntile_of_rank
from tidemark.operators.overview import event_mix, kpis
from tidemark.operators.quality import audit, business_rule_audit, null_key_audit, orphan_audit
from tidemark.operators.rfm import rfm_base, rfm_customers, rfm_label, rfm_scores, rfm_segments

__all__ = [
    "DEFAULT_STAGES", "audit", "business_rule_audit", "cohort_counts", "cohort_matrix",
    "cohort_matrix_freq", "cohort_retention", "count_states", "densify_stages", "distinct_counts",
    "distinct_rollup", "distinct_states", "event_mix", "funnel_all", "funnel_by_segment", "funnel_rates", "funnel_reach", "funnel_segment", "funnel_unordered",
    "global_ntile", "kpis", "merge_states", "ntile_columns", "ntile_of_rank", "null_key_audit", "orphan_audit", "rfm_base",
    "rfm_customers", "rfm_label", "rfm_scores", "rfm_segments",
]
