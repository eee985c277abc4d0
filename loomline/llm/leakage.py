"""Evaluation texts that leak into training text: a distributed positional inverted index.

1. Postings: one pass over the documents stores, for each, the terms that any test item uses and their
   positions. The tested vocabulary is sent along if it has at most ``max_vocabulary`` terms; beyond that all
   terms are stored.
2. Rarest first: for each run of ``length`` words of a test item, its ``rarest`` terms of least document
   frequency are the anchors. Only the postings of anchors meet the test items; each meeting fixes the offset
   of a possible match, and an offset stays if all anchors of some run agree on it, as those of any exact
   match do.
3. Intersection: at such offsets the lists of the other terms are joined in, and runs of consecutive
   positions of at least ``length`` words are exact matches.
4. Proximity: the same lists are intersected with slack. Where all but one of the anchors of a run stand at offsets that
   differ by less than twice ``slack``, the lists of the other terms are looked up in the document's row, and an item of which ``length`` of some ``near_window``
   consecutive words stand there, in any order and with other words between them, is a near match.

Nulls: documents or items with a null id or text are left out. Repeated rows count once. Extra columns
are ignored; an empty side gives no rows. Items of fewer than ``length`` words can't leak.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import broadcast_if_small, plain_words
from loomline.session import cut_lineage, written


def term_id(word: str) -> int:
    """63 bits that stand for a word in the index."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little") >> 1


def _test_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for i, field, t in zip(pdf["item_id"], pdf["field"], pdf["text"], strict=True):
            if isinstance(t, str):
                rows += [(i, field, k, w, term_id(w)) for k, w in enumerate(plain_words(t))]
        yield pd.DataFrame(rows, columns=["item_id", "field", "tpos", "word", "term"])


def _postings(vocabulary: dict[str, int] | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, terms, places = [], [], []
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not isinstance(t, str):
                    continue
                w = plain_words(t)
                at = [k for k, x in enumerate(w) if x in vocabulary] if vocabulary is not None else list(range(len(w)))
                if at:
                    ids.append(i)
                    terms.append([vocabulary[w[k]] if vocabulary is not None else term_id(w[k]) for k in at])
                    places.append(at)
            if ids:
                yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "terms": terms, "places": places})

    return run


def test_terms(items: DataFrame, fields: tuple[str, ...] = ("question", "reference_answer")) -> DataFrame:
    """(item_id, field, tpos, word, term) of each word of the test items."""
    long = None
    for f in fields:
        part = items.filter("id IS NOT NULL").select(F.col("id").cast("string").alias("item_id"), F.lit(f).alias("field"), F.col(f).alias("text")).distinct()
        long = part if long is None else long.unionByName(part)
    return long.mapInPandas(_test_terms, "item_id string, field string, tpos int, word string, term bigint")


def index(documents: DataFrame, vocabulary: dict[str, int] | None) -> DataFrame:
    """(doc_id, terms, places): the stored postings, by document."""
    rows = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return written(rows.mapInPandas(_postings(vocabulary), "doc_id bigint, terms array<bigint>, places array<int>"), "postings")


def matches(documents: DataFrame, items: DataFrame, length: int = 12, rarest: int = 4, max_vocabulary: int = 200_000, near: bool = False, near_window: int = 15, slack: int = 6) -> DataFrame:
    """(doc_id, item_id, field, longest_run, matched_words, first_pos): exact runs of at least ``length`` words.

    With ``near`` there are also a ``kind``, exact or near, and the ``share`` of the item's words that stand there; a near match has no
    exact one of the same item, its ``longest_run`` is null and ``matched_words`` counts the item's words that are met.
    """
    terms = cut_lineage(test_terms(items))
    words = [r[0] for r in terms.select("word").distinct().limit(max_vocabulary + 1).collect()]
    postings = index(documents, {w: term_id(w) for w in words} if len(words) <= max_vocabulary else None)
    frequency = postings.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ranked = terms.join(frequency, "term", "left").withColumn("entry", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "tpos"))
    run = Window.partitionBy("item_id", "field").orderBy("tpos").rowsBetween(0, length - 1)
    first = F.slice(F.array_sort(F.collect_list("entry").over(run)), 1, rarest)  # of ``length`` entries
    chosen = ranked.withColumn("best", first).withColumn("words", F.count("*").over(run)).filter(F.col("words") == length).filter(F.col("best")[0]["df"] > 0)
    anchors = chosen.select("item_id", "field", F.explode("best").alias("b")).select("item_id", "field", F.col("b.term").alias("term"), F.col("b.tpos").alias("tpos")).distinct()
    anchors = broadcast_if_small(cut_lineage(anchors))
    lists = postings.select("doc_id", F.explode(F.arrays_zip("terms", "places")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.places").alias("pos"))
    windows = chosen.groupBy("item_id", "field").agg(F.collect_set(F.array_sort(F.transform("best", lambda x: x["tpos"]))).alias("windows"))  # as many as an item has words
    if near:
        return _both_kinds(postings, lists.join(anchors, "term"), terms, windows, length, rarest, near_window, slack)
    met = lists.join(anchors, "term").groupBy("doc_id", "item_id", "field", (F.col("pos") - F.col("tpos")).alias("shift")).agg(F.collect_set("tpos").alias("at")).filter(F.size("at") >= rarest)
    whole = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("at"))) == 0)
    offsets = cut_lineage(met.join(broadcast_if_small(cut_lineage(windows)), ["item_id", "field"]).filter(whole).select("doc_id", "item_id", "field", "shift"))
    hit = postings.join(broadcast_if_small(offsets.select("doc_id").distinct()), "doc_id", "left_semi")
    of_hits = hit.select("doc_id", F.explode(F.arrays_zip("terms", "places")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.places").alias("pos"))
    expected = offsets.join(broadcast_if_small(terms.drop("word")), ["item_id", "field"]).withColumn("pos", F.col("tpos") + F.col("shift"))
    met = expected.join(of_hits, ["doc_id", "term", "pos"]).select("doc_id", "item_id", "field", "shift", "tpos").distinct()
    line = Window.partitionBy("doc_id", "item_id", "field", "shift").orderBy("tpos")
    runs = (
        met.withColumn("island", F.col("tpos") - F.row_number().over(line))
        .groupBy("doc_id", "item_id", "field", "shift", "island").agg(F.count("*").alias("words"), F.min(F.col("tpos") + F.col("shift")).alias("first_pos"))
        .filter(F.col("words") >= length)
    )
    return runs.groupBy("doc_id", "item_id", "field").agg(F.max("words").alias("longest_run"), F.sum("words").alias("matched_words"), F.min("first_pos").alias("first_pos"))


def _candidates(met: DataFrame, windows: DataFrame, rarest: int, slack: int) -> DataFrame:
    """(doc_id, item_id, field, bands): where all but one of the anchors of a run stand close together. A band holds the offsets from (band - 1) x slack
    to below (band + 1) x slack, so that any two offsets less than ``slack`` apart share one, and an exact match lies in two."""
    low = F.floor((F.col("pos") - F.col("tpos")) / slack)
    both = met.groupBy("doc_id", "item_id", "field").agg(F.collect_set(F.struct(low.alias("low"), "tpos")).alias("met")).filter(F.size("met") >= rarest - 1)  # bounded by the anchors in one document
    bands = F.array_distinct(F.flatten(F.transform("met", lambda m: F.array(m["low"], m["low"] + 1))))
    inside = F.filter("met", lambda m: (m["low"] == F.col("band")) | (m["low"] == F.col("band") - 1))
    banded = both.withColumn("band", F.explode(bands)).withColumn("at", F.array_distinct(F.transform(inside, lambda m: m["tpos"]))).filter(F.size("at") >= rarest - 1)
    most = F.exists("windows", lambda w: F.size(F.array_except(w, F.col("at"))) <= 1)
    held = banded.join(broadcast_if_small(cut_lineage(windows)), ["item_id", "field"]).filter(most)
    return held.groupBy("doc_id", "item_id", "field").agg(F.collect_set("band").alias("bands"))


def _met_positions(terms: np.ndarray, places: np.ndarray, asked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two posting lists intersected: (place in the item, place in the document) of each common term. ``terms`` is sorted."""
    left, right = np.searchsorted(terms, asked, "left"), np.searchsorted(terms, asked, "right")
    n = right - left
    index = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(at, n), places[index]


def _exact_runs(tpos: np.ndarray, pos: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(words, first place) of each run of at least ``length`` consecutive words at one offset."""
    shifts, n = np.unique(pos - tpos, return_counts=True)
    runs = []
    for shift in shifts[n >= length]:
        t = np.unique(tpos[pos - tpos == shift])
        for island in np.split(t, np.flatnonzero(np.diff(t) > 1) + 1):
            if len(island) >= length:
                runs.append((len(island), int(island[0] + shift)))
    return runs


def _near_bands(tpos: np.ndarray, pos: np.ndarray, bands: np.ndarray, length: int, near_window: int, slack: int) -> list[tuple[int, int]]:
    """(words met, first place) of each band in which ``length`` of ``near_window`` consecutive words of the item stand."""
    found, shift = [], pos - tpos
    for band in bands:
        inside = (shift >= (band - 1) * slack) & (shift < (band + 1) * slack)
        t = np.unique(tpos[inside])
        if len(t) >= length and (np.searchsorted(t, t + near_window) - np.arange(len(t))).max() >= length:
            found.append((len(t), int(pos[inside].min())))
    return found


def _verify(length: int, near_window: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            offsets, terms, places = b.column("terms").offsets.to_numpy(), b.column("terms").values.to_numpy(), b.column("places").values.to_numpy()
            asked, own = b.column("asked").offsets.to_numpy(), b.column("asked").values
            names, fields = own.field("item_id").to_pylist(), own.field("field").to_pylist()
            in_item, item_terms, item_places = own.field("terms").offsets.to_numpy(), own.field("terms").values.to_numpy(), own.field("places").values.to_numpy()
            in_bands, bands = own.field("bands").offsets.to_numpy(), own.field("bands").values.to_numpy()
            for d, doc in enumerate(ids):
                order = np.argsort(terms[offsets[d] : offsets[d + 1]], kind="stable") + offsets[d]
                t, p = terms[order], places[order]
                for c in range(asked[d], asked[d + 1]):
                    part = slice(in_item[c], in_item[c + 1])
                    tpos, pos = _met_positions(t, p, item_terms[part], item_places[part])
                    runs = _exact_runs(tpos, pos, length)
                    met = runs or _near_bands(tpos, pos, bands[in_bands[c] : in_bands[c + 1]], length, near_window, slack)
                    if met:
                        words = [n for n, _ in met]
                        rows.append((doc, names[c], fields[c], "exact" if runs else "near", max(words) if runs else None, sum(words) if runs else max(words), min(f for _, f in met)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _MATCH, strict=True)], names=["doc_id", "item_id", "field", "kind", "longest_run", "matched_words", "first_pos"])

    return run


_MATCH = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]


def _both_kinds(postings: DataFrame, met: DataFrame, terms: DataFrame, windows: DataFrame, length: int, rarest: int, near_window: int, slack: int) -> DataFrame:
    """Exact and near matches. The places to look at, which exact matches are among, are brought to the postings of their document, one row each, and
    the lists are intersected there; no list is opened and shuffled term by term."""
    entry = F.array_sort(F.collect_list(F.struct("term", "tpos")))
    items = terms.groupBy("item_id", "field").agg(entry.alias("e")).select("item_id", "field", F.col("e.term").alias("terms"), F.col("e.tpos").alias("places"), F.size("e").alias("item_words"))
    items = cut_lineage(items)
    places = _candidates(met, windows, rarest, slack).join(broadcast_if_small(items.drop("item_words")), ["item_id", "field"])
    asked = places.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "field", "bands", "terms", "places")).alias("asked"))
    found = postings.join(asked, "doc_id").mapInArrow(_verify(length, near_window, slack), "doc_id bigint, item_id string, field string, kind string, longest_run bigint, matched_words bigint, first_pos int")
    best = F.min(F.struct("kind", (-F.col("longest_run")).alias("r"), (-F.col("matched_words")).alias("w"), "first_pos"))  # repeated rows of a document
    one = found.groupBy("doc_id", "item_id", "field").agg(best.alias("b")).select("doc_id", "item_id", "field", (-F.col("b.r")).alias("longest_run"), (-F.col("b.w")).alias("matched_words"), "b.first_pos", "b.kind")
    share = F.round(F.least(F.lit(1.0), F.col("matched_words") / F.col("item_words")), 6)
    return one.join(broadcast_if_small(items.select("item_id", "field", "item_words")), ["item_id", "field"]).withColumn("share", share).drop("item_words")


def leaks(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of each item that leaked into a document."""
    return found.select("doc_id", "item_id").distinct()
