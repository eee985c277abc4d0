"""Question log: gates, history, log statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as T

# Exact inputs that are small talk, by class.
SMALL_TALK = {
    "greeting": ["hi", "hello", "hey", "hi there", "good morning", "good evening", "bonjour", "hallo", "hola", "guten tag"],
    "thanks": ["thanks", "thank you", "merci", "danke", "gracias", "thx"],
    "farewell": ["bye", "goodbye", "see you", "au revoir", "tschüss", "adiós"],
}
DETAIL = ["explain", "why", "how", "mechanism", "pourquoi", "warum", "wie ", "por qué", "cómo"]
VAGUE = [" it ", " this ", " that ", " they ", " those ", " cela ", " das ", " eso "]


def normal(q: Column) -> Column:
    """Lower case, marks at the ends dropped, white space squeezed."""
    return T.squeeze(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), r"[^\p{L}\p{N}\s\p{Z}]+", " "))


def small_talk(q: Column) -> Column:
    """Class of small talk by exact membership; empty input greets; null if none."""
    n = normal(q)
    out = F.when(n == "", F.lit("greeting"))
    for kind, phrases in SMALL_TALK.items():
        out = out.when(n.isin(*phrases), F.lit(kind))
    return out


def width(q: Column) -> Column:
    """How many sources a question needs: 12 for curt, chained or detailed ones, else 8."""
    n = normal(q)
    size = F.size(T.words(n))
    chained = F.size(F.split(n, " and ")) - 1
    return F.when(size == 0, 8).when((size <= 3) | (chained >= 2) | T.any_of(n, DETAIL), 12).otherwise(8)


def gibberish(q: Column) -> Column:
    """One character four times or more in a row, or at least four letters a-z and no vowel, or five consonants in a row in any word, or no
    vowel in any word of letters, each of four or more (so also if there is no such word)."""
    n = F.rtrim(F.regexp_replace(F.lower(F.coalesce(q, F.lit(""))), r"^\s+|\s+$", ""), F.lit("!?."))
    bare = F.regexp_replace(n, "[^a-z]", "")
    words = F.split(n, r"\s+")
    dense = F.exists(words, lambda w: F.regexp_replace(w, "[^a-z]", "").rlike("[bcdfghjklmnpqrstvwxz]{5,}"))
    dull = F.forall(F.filter(words, lambda w: w.rlike(r"^\p{L}+$")), lambda w: (F.length(w) >= 4) & ~w.rlike("[aeiou]"))
    return n.rlike(r"([^\n])\1{3,}") | ((F.length(bare) >= 4) & ~bare.rlike("[aeiou]")) | dense | dull


def event_time(ts: Column) -> Column:
    """ISO text with or without offset, with ``T`` or a blank; naive times count as UTC."""
    return F.try_to_timestamp(F.replace(F.trim(ts), F.lit("T"), F.lit(" ")))


def _asker() -> Column:
    """Rows without an asker stand alone."""
    return F.coalesce("ip_hash", F.concat(F.lit("row "), F.col("id").cast("string")))


def _with_earlier(log: DataFrame, turns: int) -> DataFrame:
    """Rows with ``_asker``, ``_day`` and ``_earlier``, the asker's last ``turns`` questions before that day. The window over an
    asker sees one short row per day, so an asker with a third of all rows is no hot task."""
    rows = log.withColumn("_asker", _asker()).withColumn("_day", F.to_date("at"))
    last = Window.partitionBy("_asker", "_day").orderBy(F.desc("at"), F.desc("id"))
    tails = rows.select("_asker", "_day", "at", "id", "question", F.row_number().over(last).alias("_r")).filter(F.col("_r") <= turns)
    days = tails.groupBy("_asker", "_day").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id", "question"))), lambda x: x["question"]).alias("_tail"))
    before = Window.partitionBy("_asker").orderBy("_day").rowsBetween(-turns, -1)
    earlier = days.withColumn("_all", F.flatten(F.collect_list("_tail").over(before))).select("_asker", "_day", F.slice("_all", F.greatest(F.lit(1), F.size("_all") - (turns - 1)), F.lit(turns)).alias("_earlier"))
    return rows.join(earlier, ["_asker", "_day"])


def history(log: DataFrame, turns: int = 4, chars: int = 200) -> DataFrame:
    """(id, history): the last questions of the same asker before each row, each cut to ``chars``. Rows without a time are left out."""
    w = Window.partitionBy("_asker", "_day").orderBy("at", "id").rowsBetween(-turns, -1)
    rows = _with_earlier(log.filter("at IS NOT NULL"), turns).withColumn("_own", F.collect_list("question").over(w))
    missing = turns - F.size("_own")
    fill = F.when(missing > 0, F.slice("_earlier", F.greatest(F.lit(1), F.size("_earlier") - missing + 1), missing)).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.concat_ws(" / ", F.transform(F.concat(fill, F.col("_own")), lambda q: F.substring(q, 1, chars))).alias("history"))


def resolve(log: DataFrame) -> DataFrame:
    """(id, resolved, vague): a vague question gets the asker's question before it in front. Rows without a time are left out."""
    w = Window.partitionBy("_asker", "_day").orderBy("at", "id")
    rows = _with_earlier(log.filter("at IS NOT NULL"), 1).withColumn("_before", F.coalesce(F.lag("question").over(w), F.get(F.col("_earlier"), F.lit(0))))
    before = F.col("_before")
    vague = T.any_of(F.concat(F.lit(" "), F.col("question"), F.lit(" ")), VAGUE) & before.isNotNull()
    return rows.select("id", F.when(vague, F.concat(before, F.lit(" — "), "question")).otherwise(F.col("question")).alias("resolved"), vague.alias("vague"))


def busiest(calls: DataFrame, key: str, reach: int) -> DataFrame:
    """Calls (key, us) with ``n``, the calls of the key in the ``reach`` microseconds up to each. Each call is a member of its own
    bin and a guest in the next, so a window sees two bins of one key and never all its rows."""
    bin_ = F.floor(F.col("us") / reach)
    placed = calls.withColumn("_bin", bin_).withColumn("_in", F.explode(F.array(bin_, bin_ + 1)))
    w = Window.partitionBy(key, "_in").orderBy("us").rangeBetween(-reach, 0)
    return placed.withColumn("n", F.count("*").over(w)).filter(F.col("_in") == F.col("_bin")).drop("_in", "_bin")


def salted_hash(value: Column, salt: str) -> Column:
    """Sixteen hex digits of a salted SHA-256; empty for null or empty."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16))
