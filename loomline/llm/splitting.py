"""Splitting oversized items at natural boundaries by content-defined chunking.

A rolling hash over the characters sets landmarks; a cut goes to the natural boundary nearest to the
first landmark between the least and the greatest size, better kinds of boundary first. As landmarks
depend on nearby text only, an edit moves the cuts of neighbouring pieces and no others. Items are split
each on its own in one narrow map; nothing is shuffled.

A stretch without white space that is itself longer than the limit is cut by force; no other is.

Nulls: null or empty texts, and items within the limit, give one piece ``end_of_text`` (null: none).
Repeated items are split once. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import broadcast_if_small

# Kinds of boundary, the best first; each pattern ends where the next piece may begin.
BOUNDARIES = (
    ("section_header", re.compile(r"\n[ \t]*(?=#{1,6}\s|\*\*[^*\n]{1,80}\*\*\s*\n)")),
    ("paragraph_break", re.compile(r"(?:\r?\n[ \t]*){2,}")),
    ("line_break", re.compile(r"\r?\n+")),
    ("sentence_end", re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+(?=[\"'“«(\[¿¡]*[^\Wa-z_])|(?<=[.!?…])\s*(?:\[\d[\d, ]*\]\s*)+")),
    ("clause_break", re.compile(r"(?<=[,;:–—])\s+")),
    ("simple_break", re.compile(r"\s+")),
)
WINDOW = 16


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions whose hash of the last ``WINDOW`` characters is divisible by ``spacing``."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return np.flatnonzero((h >> np.uint64(33)) % np.uint64(spacing) == 0) + WINDOW


def split(text: str, limit: int, overlap: int, least: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the break at its end) of each piece. Ends are exclusive."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end_of_text")]
    least = limit // 4 if least is None else least
    marks = landmarks(text, max(2, limit // 4))
    found = [(kind, np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64)) for kind, p in BOUNDARIES]
    spaces = found[-1][1]
    out: list[tuple[int, int, str]] = []
    done = 0  # all before this is covered
    while True:
        start = done
        if done and overlap:
            at = np.searchsorted(spaces, done - overlap)
            start = int(spaces[at]) if at < len(spaces) and spaces[at] < done else done
        if n - start <= limit:
            out.append((start, n, "end_of_text"))
            return out
        cut, kind = 0, ""
        for begin in dict.fromkeys((start, done)):
            if n - begin <= limit:  # without the overlap the rest fits
                out.append((begin, n, "end_of_text"))
                return out
            low, high = done + least, begin + limit
            if low <= high:
                i = np.searchsorted(marks, low)
                aim = int(marks[i]) if i < len(marks) and marks[i] <= high else high
                for kind_, ends in found:
                    lo, hi = np.searchsorted(ends, low), np.searchsorted(ends, high, side="right")
                    if lo < hi:
                        near = ends[lo:hi]
                        cut, kind = int(near[np.abs(near - aim).argmin()]), kind_
                        break
            if not cut:  # no boundary in the wanted range: the last one before it, whatever the size
                i = np.searchsorted(spaces, high, side="right") - 1
                if i >= 0 and spaces[i] > done:
                    cut, kind = int(spaces[i]), "simple_break"
            if not cut:  # a stretch that ends just at the limit
                m = re.compile(r"\s").search(text, done, min(n, begin + limit + 1))
                if m and m.start() > done:
                    cut, kind = m.start(), "simple_break"
            if cut:
                start = begin
                break
        if not cut:
            start, cut, kind = done, done + limit, "forced_break"
        out.append((start, cut, kind))
        done = cut


def _pieces(with_text: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for item, text, limit, overlap in zip(pdf["item_id"], pdf["text"], pdf["size_limit"], pdf["overlap"], strict=True):
                if isinstance(text, str):
                    for k, (a, b, kind) in enumerate(split(text, int(limit), int(overlap))):
                        rows.append((item, k, a, b, b - a, kind, *([text[a:b]] if with_text else [])))
            yield pd.DataFrame(rows, columns=["item_id", "piece_no", "start_pos", "end_pos", "size_chars", "break_type", *(["piece"] if with_text else [])])

    return run


def pieces(items: DataFrame, with_text: bool = False) -> DataFrame:
    """Pieces of items (item_id, text, size_limit, overlap), in order from 0."""
    schema = "item_id string, piece_no int, start_pos int, end_pos int, size_chars int, break_type string" + (", piece string" if with_text else "")
    return items.select("item_id", "text", "size_limit", "overlap").mapInPandas(_pieces(with_text), schema)


def oversized(search_results: DataFrame, chunk_metadata: DataFrame, documents: DataFrame, context_limit: int = 1000, chunk_limit: int = 6000, context_overlap: int = 100, chunk_overlap: int = 400) -> DataFrame:
    """Items above their limit: contexts of passages, and earlier pieces of documents. A passage id that comes twice is taken once."""
    contexts = (
        search_results.filter(F.col("id").isNotNull() & (F.length("context") > context_limit))
        .groupBy(F.col("id").alias("item_id"))
        .agg(F.max("context").alias("text"))
        .select("item_id", "text", F.lit(context_limit).alias("size_limit"), F.lit(context_overlap).alias("overlap"))
    )
    large = chunk_metadata.filter(F.col("end_pos") - F.col("start_pos") > chunk_limit).select("doc_id", "chunk_id", "start_pos", "end_pos").distinct()
    texts = documents.select("doc_id", F.col("text").alias("doc_text"))
    chunks = texts.join(broadcast_if_small(large), "doc_id").select(
        F.concat_ws(":", "doc_id", "chunk_id").alias("item_id"),
        F.expr("substring(doc_text, start_pos + 1, end_pos - start_pos)").alias("text"),
        F.lit(chunk_limit).alias("size_limit"),
        F.lit(chunk_overlap).alias("overlap"),
    )
    return contexts.unionByName(chunks)


def forced_items(cut: DataFrame) -> DataFrame:
    """(item_id, forced): 1 where a piece of the item ends by force."""
    return cut.groupBy("item_id").agg(F.max((F.col("break_type") == "forced_break").cast("int")).alias("forced"))
