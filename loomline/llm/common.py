"""Small helpers that the training-data operators share."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType


def broadcast_if_small(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Hint a broadcast only after adding up the bytes of the rows; beyond ``max_bytes`` Spark joins by shuffle. The plan of ``df`` runs
    once more for this: hand in a table that is cheap to read again."""

    def size(f: StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 24
        return F.length(F.to_json(F.struct(c))) * 4 if isinstance(f.dataType, (ArrayType, StructType, MapType)) else F.lit(8)

    total = df.agg(F.sum(sum((size(f) for f in df.schema), F.lit(16))).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if (total or 0) <= max_bytes else df


def clean_path(path: Column) -> Column:
    """Paths with one kind of slash."""
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


# The kinds of source and the spellings they come in, after lower case and removal of all but letters.
KINDS = {
    "transcript": ("transcript", "transcripts", "audio", "audiotranscript", "audiotranscripts"),
    "article": ("article", "articles"),
    "newsletter": ("newsletter", "newsletters"),
    "email": ("email", "emails", "mail", "mails"),
    "academic": ("academic", "academics", "paper", "papers", "academicpaper", "academicdocument"),
    "forum": ("forum", "forums"),
    "webpage": ("webpage", "webpages", "website", "web"),
    "other": ("other", "others", "misc", "miscellaneous"),
}


def one_kind(col: Column) -> Column:
    """A source kind in one spelling; blanks give null, unknown kinds stay, trimmed and in lower case."""
    letters = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}]", "")
    out = F.when(letters == "", F.lit(None))
    for kind, names in KINDS.items():
        out = out.when(letters.isin(*names), F.lit(kind))
    return out.otherwise(F.lower(F.trim(col)))


_MOJIBAKE = re.compile("[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3}")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_DIVIDED = re.compile(r"(\w)[-‐‑]\s{0,8}[\r\n  ]{1,4}[\s>|*]{0,16}(?=\w)")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,300}>")
_WORD = re.compile(r"[^\W_]+")


def _decode(m: re.Match) -> str:
    try:
        return m.group(0).encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        try:
            return m.group(0).encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group(0)


def repair(text: str) -> str:
    """Entities resolved, wrongly decoded letters put right, invisible characters dropped."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text
    if _MOJIBAKE.search(text):
        text = _MOJIBAKE.sub(_decode, text)
    return _INVISIBLE.sub("", text)


def plain_words(text: str) -> list[str]:
    """Words regardless of case, accents, marks, markup, white space and division at line ends."""
    t = repair(text)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "\n" in t or "\r" in t:
        t = _DIVIDED.sub(r"\1", t)
    t = t.lower()
    if not t.isascii():
        t = without_marks(t)
    return _WORD.findall(t)


def without_marks(text: str) -> str:
    """Letters without accents: compatibility decomposition, combining marks left out."""
    text = unicodedata.normalize("NFKD", text)
    if len(text) < 64:
        return "".join([c for c in text if not unicodedata.combining(c)])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes[~_characters()[1][codes]].tobytes().decode("utf-32-le", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points belong to words, and which are combining marks."""
    planes = 0x20000
    word = np.zeros(0x110000, dtype=bool)
    word[:planes] = [chr(c).isalnum() for c in range(planes)]
    word[planes:0xE0000] = True
    mark = np.zeros(0x110000, dtype=bool)
    mark[:planes] = [unicodedata.combining(chr(c)) > 0 for c in range(planes)]
    return word, mark


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, 64-bit hash of each word in order) of a whole batch, without a list of words. Words are runs of
    letters and digits; combining marks are left out."""
    word, mark = _characters()
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not all(map(str.isascii, texts)):
        keep = ~mark[codes]
        ends = np.cumsum(keep)[ends - 1]
        codes = codes[keep]
    inside = word[codes]
    first = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    counts = np.diff(np.r_[0, np.searchsorted(first, ends)])
    if not len(first):
        return counts, np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(inside)
    start = np.searchsorted(at, first)
    place = (at - np.repeat(first, np.diff(np.r_[start, len(at)]))).astype(np.uint64)
    return counts, mix(np.add.reduceat(mix(codes[at].astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)), start))
