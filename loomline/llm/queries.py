"""Queries of the training-data operators, over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import leakage, mixing, near_duplicates, qa_defects, splitting, token_budget, toxicity, transcripts
from loomline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return qa_defects.defects(table(spark, d, "conversations"))


def p1_defect_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    known = rows.filter("id IS NOT NULL").groupBy("id").agg(F.upper(F.trim(F.max("confidence"))).alias("confidence"))
    found = qa_defects.defects(rows)
    return known.join(found, "id", "left").groupBy(F.coalesce("confidence", F.lit("(none)")).alias("confidence"), F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("pairs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs_in_groups(near_duplicates.groups(table(spark, d, "search_results")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(table(spark, d, "search_results"))


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget(token_budget.measured(table(spark, d, "search_results"), table(spark, d, "source_files")))


def _cut(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    items = splitting.oversized(table(spark, d, "search_results"), table(spark, d, "chunk_metadata"), table(spark, d, "documents"))
    return splitting.pieces(items, with_text)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.forced_items(_cut(spark, d, False))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.speaker_turns(table(spark, d, "search_results"), table(spark, d, "speakers"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.speaker_turns(table(spark, d, "search_results"), table(spark, d, "speakers"), with_text=True)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(leakage.matches(table(spark, d, "documents"), table(spark, d, "eval_questions")))


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.matches(table(spark, d, "documents"), table(spark, d, "eval_questions"), near=True)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged(toxicity.scores(table(spark, d, "documents"), table(spark, d, "review_labels")))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.scores(table(spark, d, "documents"), table(spark, d, "review_labels")).select("doc_id", *[F.round(c, 6).alias(c) for c in toxicity.CATEGORIES], *[f"{c}_{e}" for c in toxicity.CATEGORIES for e in ("from", "to")])


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.rates(docs, toxicity.scores(docs, table(spark, d, "review_labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_defect_rates, p2_found, p2_groups, p3_token_budget, p4_found, p4_pieces, p5_found, p5_turns, p6_found, p6_matches, p7_shares, p7_selection, p8_found, p8_scores, p8_rates)}


def oracle_sql() -> dict[str, str]:
    """None: tokenizers, automata and parsers can't be said in SQL; tests compare them with brute force."""
    return {}
