"""Corpus ETL: fingerprints, quality gate, topics, audits, cleaning, joins by title and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T


def first_of_each(df: DataFrame, key: Column, order: str, short: Column | None = None) -> DataFrame:
    """(key, first, copies): the least ``order`` of each key. Rows where ``short`` holds are each kept on their own.

    One aggregate with map-side combine, so a key that holds a third of all rows is no hot task. Null keys form one class.
    """
    own = F.concat_ws("#", key, F.col(order).cast("string"))
    return df.groupBy((F.when(short, own).otherwise(key) if short is not None else key).alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def quality_reason(text: Column, fillers: list[str], least_words: int = 25, gap: int = 8) -> Column:
    """Why a text is dropped: ``short``, ``gap`` (a run of underscores), ``filler``; ``kept`` otherwise. Null counts as short."""
    return (
        F.when(T.fingerprint(F.coalesce(text, F.lit(""))).isin(*fillers), F.lit("filler"))
        .when(F.coalesce(text, F.lit("")).contains("_" * gap), F.lit("gap"))
        .when(T.word_count(text) < least_words, F.lit("short"))
        .otherwise(F.lit("kept"))
    )


def top_topics(text: Column, taxonomy: dict[str, list[str]], k: int = 3) -> Column:
    """The k topics with most keywords present, ties in the order of declaration; empty if none."""

    def ranked(low: Column) -> Column:
        scored = F.array(*[F.struct((-T._hits(low, kw)).alias("score"), F.lit(i).alias("ord"), F.lit(t).alias("topic")) for i, (t, kw) in enumerate(taxonomy.items())])
        return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["score"] < 0)), 1, k), lambda x: x["topic"])

    return T.once(F.lower(F.coalesce(text, F.lit(""))), ranked)


def padded_words(text: Column) -> Column:
    """Lower case words, each between two blanks, for counts of whole words and phrases."""
    return F.concat(F.lit("  "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit("  "))


def phrase_count(padded: Column, phrase: str) -> Column:
    inner = " " + phrase.replace(" ", "  ") + " "
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(inner), F.lit("")))) / len(inner)).cast("int")


def weighted_topic(text: Column, keywords: list[str]) -> Column:
    """Whole-word counts weighted by keyword length / 10, over the number of keywords."""

    def total(padded: Column) -> Column:
        out = F.lit(0.0)
        for k in keywords:
            out = out + phrase_count(padded, k) * (len(k) / 10.0)
        return F.round(out / len(keywords), 6)

    return T.once(padded_words(text), total)


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, least, greatest, mean, upper_median): the element at n // 2 of the sorted values.

    Values are first counted, so the running sum goes over distinct values and not over rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    run = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(group)
    cum = counts.withColumn("cum", F.sum("c").over(run)).withColumn("n", F.sum("c").over(every))
    return cum.groupBy(group).agg(
        F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("mean"),
        F.min(F.when(F.col("cum") > F.floor(F.col("n") / 2), F.col(value))).alias("upper_median"),
    )


def match_share(text: Column, patterns: list[str]) -> Column:
    """Share of the characters that match the patterns, at most 1; short texts give 0."""
    t = F.coalesce(text, F.lit(""))
    total = F.lit(0)
    for p in patterns:
        total = total + F.aggregate(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.length(t) < 50, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.round(total / F.length(t), 6)))


def clean_by_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements, then white space squeezed."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return T.squeeze(out)


def difficulty(text: Column, technical: list[str]) -> Column:
    """0.4 * sentence length + 0.3 * variety of words + 0.3 * share of technical words, each capped at 1; 0.5 for no words."""
    sentences = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([.!?]+)"), F.lit(1))))

    def score(w: Column) -> Column:
        n = F.size(w)
        tech = F.size(F.filter(w, lambda x: x.isin(*technical)))
        value = 0.4 * F.least(F.lit(1.0), n / sentences / 30) + 0.3 * F.least(F.lit(1.0), 3 * F.size(F.array_distinct(w)) / n) + 0.3 * F.least(F.lit(1.0), 10 * tech / n)
        return F.when(n == 0, F.lit(0.5)).otherwise(F.round(value, 6))

    return T.once(T.letters(text), score)


def overlap_join(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """(lid, rid, overlap): rows of left (lid, words) and right (rid, words) that share more than ``share`` of the left's distinct words.

    Prefix filter: a pair over the share has one of the left row's rarest words in common, so only those are
    joined; common words meet nobody.
    """
    lw = left.select("lid", F.array_distinct("words").alias("lw")).filter(F.size("lw") > 0)
    rw = right.select("rid", F.array_distinct("words").alias("rw")).filter(F.size("rw") > 0)
    r_long = rw.select("rid", F.explode("rw").alias("word"))
    freq = r_long.groupBy("word").agg(F.count("*").alias("df"))
    l_long = lw.select("lid", F.explode("lw").alias("word")).join(freq, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n = Window.partitionBy("lid")
    rare = (
        l_long.withColumn("n", F.count("*").over(n)).withColumn("pos", F.row_number().over(n.orderBy("df", "word")))
        .filter(F.col("pos") <= F.col("n") - F.floor(F.col("n") * share)).filter("df > 0")
    )
    pairs = rare.join(r_long, "word").select("lid", "rid").distinct()
    met = pairs.join(lw, "lid").join(rw, "rid")
    return met.select("lid", "rid", F.round(F.size(F.array_intersect("lw", "rw")) / F.size("lw"), 6).alias("overlap")).filter(F.col("overlap") > share)


def marked_parts(df: DataFrame, id_col: str, text_col: str, speech: str, context: str) -> DataFrame:
    """(id, chunk_index, text, context): a speech part runs to the next marker; its context is the next part if that is
    a context, else the one before it."""
    part = r"(?s)^\*\*([^*:]+):\*\*\s*(.*)$"
    cut = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), r"(?=\*\*(?:" + speech + "|" + context + r"):\*\*)")).alias("pos", "raw"))
    parts = cut.select(id_col, "pos", F.regexp_extract("raw", part, 1).alias("tag"), F.trim(F.regexp_extract("raw", part, 2), F.lit(" \n\r\t")).alias("body")).filter("tag <> ''")
    w = Window.partitionBy(id_col).orderBy("pos")
    near = parts.withColumn("after", F.lead(F.when(F.col("tag") == context, F.col("body"))).over(w)).withColumn("before", F.lag(F.when(F.col("tag") == context, F.col("body"))).over(w))
    said = near.filter(F.col("tag") == speech)
    return said.select(id_col, (F.row_number().over(w) - 1).alias("chunk_index"), F.col("body").alias("text"), F.coalesce("after", "before", F.lit("")).alias("context"))
