"""Answers with a source footer; packing of parts; words of a vocabulary."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T

RULE = "\n\n---\nSources:\n"

# Phrases by which an answer abstains or pushes back on the question; {person} stands for the name of the author asked
# about, a parameter. Phrases with a person are left out where no name is given.
ABSTAINS = [
    "sources do not cover", "sources don't cover", "sources do not discuss", "sources don't discuss", "not covered in the sources", "not covered in the corpus", "not addressed in the sources",
    "insufficient sources", "insufficient_sources", "insufficient information", "no information in the sources", "no coverage", "no direct coverage", "no evidence in the sources", "cannot find",
    "unable to find", "i cannot answer", "i can't answer", "cannot provide", "does not appear in", "doesn't appear in", "did not address", "didn't address", "never addressed", "never discussed",
    "no record of", "not discussed by {person}", "{person} did not discuss", "{person} didn't discuss", "don't have sufficient information", "do not have sufficient information",
    "answer this question reliably", "weakly related to your query",
]
PUSHES_BACK = [
    "actually opposed", "actually considered", "in fact opposed", "the premise", "opposite of", "contrary to", "{person} did not recommend", "{person} didn't recommend", "{person} opposed",
    "{person} warned against", "{person} was opposed", "{person} was skeptical", "{person} considered", "{person} viewed", "this misrepresents", "this is a misattribution", "mischaracteriz", "{person} actually",
]


def phrases(kind: list[str], person: str | None = None) -> list[str]:
    return [p.format(person=person.lower()) if person else p for p in kind if person or "{person}" not in p]


def abstention(answer: Column, person: str | None = None) -> Column:
    """``abstained``, ``premise_rejected`` or ``answered``; abstaining wins. Null or empty counts as answered."""
    return F.when(T.any_of(answer, phrases(ABSTAINS, person)), "abstained").when(T.any_of(answer, phrases(PUSHES_BACK, person)), "premise_rejected").otherwise("answered")


def without_claims(answer: Column, claims: Column) -> Column:
    """The answer without the sentences that hold one of the ``claims`` or are held by one, regardless of case; null claims strip nothing."""

    def kept(s: Column) -> Column:
        low = F.lower(s)
        return ~F.exists(F.coalesce(claims, F.array().cast("array<string>")), lambda c: F.contains(low, F.lower(c)) | F.contains(F.lower(c), low))

    return F.array_join(F.filter(T.sentences(answer), kept), " ")


def render_footer(body: Column, sources: Column, confidence: Column) -> Column:
    """Body, numbered sources (an array of paths) and a confidence line."""
    lines = F.transform(sources, lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p))
    return F.concat(F.coalesce(body, F.lit("")), F.lit(RULE), F.concat_ws("\n", F.coalesce(lines, F.array().cast("array<string>"))), F.lit("\nConfidence: "), F.coalesce(confidence, F.lit("none")))


def parse_footer(text: Column) -> Column:
    """struct(body, sources, confidence): sources without repeats, in order; without a footer all is body."""
    at = F.locate(RULE, text)
    tail = F.when(at > 0, F.expr("''")).otherwise(F.lit(""))
    tail = F.when(at > 0, F.substring(text, at + len(RULE), F.length(text))).otherwise(tail)
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("body"),
        F.array_distinct(F.regexp_extract_all(tail, F.lit(r"(?m)^[0-9]+\. (.+)$"), F.lit(1))).alias("sources"),
        F.nullif(F.regexp_extract(tail, r"(?m)^Confidence: (.+)$", 1), F.lit("")).alias("confidence"),
    )


def pack(parts: Column, budget: int) -> Column:
    """Lengths of batches: parts in order, a new batch where the next part would go over the budget. A part over the
    budget is a batch of its own. A fold over one row's parts."""
    sizes = F.transform(parts, lambda p: F.length(p).cast("bigint"))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("open"))
    fits = lambda acc, n: (acc["open"] == 0) | (acc["open"] + n <= budget)
    step = lambda acc, n: F.struct(
        F.when(fits(acc, n), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits(acc, n), acc["open"] + n).otherwise(n).alias("open")
    )
    return F.aggregate(sizes, start, step, lambda acc: F.when(acc["open"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def grounded(entity: Column, quote: Column, stop: list[str]) -> Column:
    """At least one key word of the entity (longer than 2, not in the stop list) occurs in the quote; none to look for passes."""
    words = F.filter(F.split(F.lower(F.coalesce(entity, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    low = F.lower(F.coalesce(quote, F.lit("")))
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(low, w))


def jargon(df: DataFrame, id_col: str, words_col: str, vocabulary: list[str], least: float = 0.85) -> DataFrame:
    """(id, exact, fuzzy): words of a row that are in the vocabulary, and those that are nearly (difflib ratio of at least
    ``least``). The vocabulary is a parameter and small; distinct words are compared once per task."""
    known = frozenset(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, bool] = {}

        def fuzzy(w: str) -> bool:
            if w not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen[w] = bool(difflib.get_close_matches(w, vocabulary, 1, least))
            return seen[w]

        for pdf in frames:
            rows = [(i, sum(w in known for w in ws), sum(w not in known and fuzzy(w) for w in ws)) for i, ws in zip(pdf["id"], (w if w is not None else [] for w in pdf["words"]), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "exact", "fuzzy"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(words_col).alias("words")).mapInPandas(run, "id string, exact int, fuzzy int")
