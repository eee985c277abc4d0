"""Mixing sources to target weights.

Token counts are worked out once and stored. Each record gets a hash-random key; records are range-sorted by source and key, so that a large source
lies in many partitions. Sums per partition and source, at most partitions x sources rows, give each
partition its offset; a running sum inside the partition then gives each record its prefix sum of tokens.
A source whose budget is above its size is repeated in whole epochs and the rest is cut from the order; the
record on which the cut falls is taken if that brings the source nearer to its budget.

Nulls: records with a null id or no known source of the targets are left out; a null or empty text has
no tokens and is never chosen. Targets with a null share or source are left out; repeated targets: the
greatest share holds. Extra columns are ignored. An empty table of records or targets gives target rows
with nothing used, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import broadcast_if_small, one_kind
from loomline.llm.token_budget import TOKENIZER, count_tokens
from loomline.session import cut_lineage, discard, written


def _sizes(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": count_tokens(pdf["text"], path)})

    return run


def ordered(documents: DataFrame, tokenizer_path: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, upto): ``upto`` is the running sum of tokens in the random order of the source."""
    rows = documents.filter("doc_id IS NOT NULL").select("doc_id", one_kind(F.col("source")).alias("source"), "text")
    sized = rows.mapInPandas(_sizes(tokenizer_path), "doc_id bigint, source string, tokens bigint").filter("source IS NOT NULL AND tokens > 0")
    counts = written(sized, "counts")  # the range sort reads its input twice: to find the ranges and to sort
    keyed = counts.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    placed = cut_lineage(keyed.repartitionByRange("source", "key").withColumn("part", F.spark_partition_id()))
    discard(counts)
    sums = placed.groupBy("source", "part").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(offsets, ["source", "part"]).select("doc_id", "source", "tokens", (F.col("before") + F.sum("tokens").over(inside)).alias("upto"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Budget of each source. Without a total, the greatest total that no cap on repeats cuts short."""
    goal = (
        targets.filter("source IS NOT NULL AND target_share IS NOT NULL")
        .groupBy(one_kind(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.max("upto").alias("available_tokens"))
    both = goal.join(have, "source", "left").fillna({"available_tokens": 0})
    reach = F.when((F.col("target_share") > 0) & (F.col("available_tokens") > 0), F.col("available_tokens") * F.col("max_repeats") / F.col("target_share"))
    total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.min(reach).over(Window.partitionBy(F.lit(1)))
    return both.withColumn("total", total).withColumn(
        "budget_tokens", F.least(F.floor(F.col("target_share") * F.coalesce("total", F.lit(0.0))), F.col("available_tokens") * F.col("max_repeats")).cast("bigint")
    )


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer_path: str = TOKENIZER, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Chosen records (doc_id, source, tokens, repeats) and the shares reached per source."""
    order = cut_lineage(ordered(documents, tokenizer_path, seed))
    plan = budgets(order, targets, total_tokens).filter("source IS NOT NULL")
    epochs = F.when(F.col("available_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("available_tokens"))).otherwise(0)
    plan = cut_lineage(plan.withColumn("epochs", epochs.cast("bigint")).withColumn("rest_tokens", F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens")))
    repeats = F.col("epochs") + F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("rest_tokens"), 1).otherwise(0)
    chosen = order.join(broadcast_if_small(plan.select("source", "epochs", "rest_tokens")), "source").select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).filter("repeats > 0")
    used = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").cast("bigint").alias("used_records"), F.count("*").alias("distinct_records"), F.max("repeats").alias("most_repeats")
    )
    every = Window.partitionBy(F.lit(1))
    shares = (
        plan.join(used, "source", "left").fillna(0, ["used_tokens", "used_records", "distinct_records", "most_repeats"])
        .withColumn("actual_share", F.round(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(every)), 6))
        .select("source", "target_share", "actual_share", "max_repeats", "most_repeats", "available_tokens", "budget_tokens", "used_tokens", "used_records", "distinct_records")
    )
    return chosen, shares
