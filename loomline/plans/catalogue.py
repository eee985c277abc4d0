"""All queries of the core, with their SQL twins."""

from __future__ import annotations

from loomline.plans import answer_plans, corpus_plans, dialogue_plans, evaluate_plans, event_plans, graph_plans, relational_plans, review_plans, source_plans, stream_plans, vector_plans  # noqa: F401
from loomline.plans.registry import QUERIES, SQL, Query

# Columns whose integers are wider in SQL than in Spark, and sums that SQL gives as 128-bit integers: cast to Spark's type.
AS_INTEGER = {
    "token_stats_upper_median": ("least", "greatest", "upper_median"), "stable_ids": ("token_estimate",), "doc_metadata": ("words", "chars"), "rules_clean": ("clean_chars",), "html_text": ("chars",),
    "marker_parse": ("text_chars",), "velocity_daily": ("days",), "last_n_interactions": ("r",), "item_select_diverse": ("rank",), "expand_terms": ("rank",), "footer_round_trip": ("sources",), "rec_blend": ("rank",),
    "json_fields": ("n_parsed",), "knn_topk_batch": ("rank",), "knn_self_exclude": ("rank",), "two_pass_capped": ("file_rank",), "mmr_count_windows": ("pos",), "retrieve_diverse": ("pos",),
    "entity_grounding": ("terms", "found"), "keyword_rerank": ("pos", "rank"), "top_orders_per_customer": ("r",), "csv_round_trip": ("chars",), "hash_vectors": ("dim",), "citation_drift": ("drift",), "claims_stripped": ("claims",), "central_sentence": ("sentences",), "neighbours_ranked": ("rank",), "rerank_by_index": ("hits", "rank"), "expand_questions": ("added", "chars"),
}
AS_BIGINT = {
    "quality_gate_reasons": ("words",), "token_histogram": ("words",), "corpus_scale_rollup": ("words", "chars"), "centroid_assign": ("cluster",), "answer_metrics": ("citations",), "label_confusion": ("disputed",),
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    out = dict(SQL)
    for kind, columns in (("INTEGER", AS_INTEGER), ("BIGINT", AS_BIGINT)):
        for name, cols in columns.items():
            out[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {kind}) AS {c}' for c in cols)}) FROM ({out[name]})"
    return out
