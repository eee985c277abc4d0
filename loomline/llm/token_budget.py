"""Token budget per source, language and topic.

Each worker loads the tokenizer once, encodes whole texts batch by batch and keeps exact counts; the
totals are a Spark cube over small columns. The language is voted for by the stopwords of the text.

Nulls: a null or empty text has 0 tokens and language ``unknown``; a missing topic is ``unknown``; a
missing kind is taken from the file's row in ``source_files``, else ``unknown``. A passage that comes
twice under one id counts once; each passage with a null id counts as one of its own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import broadcast_if_small, clean_path, one_kind
from loomline.llm.languages import language

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict = {}


def tokenizer(path: str):
    """The encoding of a file of ranks; loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(texts, path: str) -> list[int]:
    """Exact counts of a batch of texts; the batch goes to the tokenizer at once, on the one core of the task."""
    ids = tokenizer(path).encode_ordinary_batch([t if isinstance(t, str) else "" for t in texts], num_threads=1)
    return [len(x) for x in ids]


def _measure(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame(
                {
                    "id": pdf["id"],
                    "source_file": pdf["source_file"],
                    "source_type": pdf["source_type"],
                    "topic": pdf["topic"],
                    "tokens": count_tokens(pdf["text"], path),
                    "lang": [language(t, "unknown") if isinstance(t, str) else "unknown" for t in pdf["text"]],
                }
            )

    return run


def measured(passages: DataFrame, source_files: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(id, source_type, lang, topic, tokens): one row per passage, with kinds and topics in one spelling."""
    rows = passages.select("id", clean_path(F.col("source_file")).alias("source_file"), "source_type", F.col("primary_topic").alias("topic"), F.col("ray_peat_response").alias("text"))
    counts = rows.mapInPandas(_measure(tokenizer_path), "id string, source_file string, source_type string, topic string, tokens bigint, lang string")
    counts = counts.withColumn("own", F.when(F.col("id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["id", "own"])  # each row without an id stays
    files = source_files.groupBy(clean_path(F.col("source_file")).alias("source_file")).agg(F.max(one_kind(F.col("source_type"))).alias("file_type"))
    joined = counts.join(broadcast_if_small(files), "source_file", "left")
    kind = F.when(F.col("source_file").startswith("01_Audio_Transcripts/"), F.lit("transcript")).otherwise(F.coalesce(one_kind(F.col("source_type")), F.col("file_type"), F.lit("unknown")))
    topic = F.coalesce(F.nullif(F.lower(F.trim("topic")), F.lit("")), F.lit("unknown"))
    return joined.select("id", kind.alias("source_type"), "lang", topic.alias("topic"), "tokens")


def budget(counts: DataFrame) -> DataFrame:
    """Totals of every slice of the cube; ``all`` stands for a dimension that is summed over."""
    dims = ("source_type", "lang", "topic")
    return counts.cube(*dims).agg(
        *[F.grouping(d).alias(f"g_{d}") for d in dims], F.count("*").alias("passages"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("max_tokens")
    ).select(*[F.when(F.col(f"g_{d}") == 1, F.lit("all")).otherwise(F.col(d)).alias(d) for d in dims], "passages", "total_tokens", "max_tokens")
