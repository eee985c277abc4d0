"""Text expressions, JVM-side. Patterns name Unicode classes outright, so they mean the same in Java and RE2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}\p{Mn}_\s\p{Z}]"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda an expression would be worked out for each element."""
    return F.transform(F.array(value), use)[0]


def squeeze(t: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(t, SPACE, " "))


def fingerprint(t: Column) -> Column:
    """Lower case, marks dropped, white space squeezed; null for null."""
    return squeeze(F.regexp_replace(F.lower(t), NOT_WORD, ""))


def words(t: Column) -> Column:
    """The words between white space; empty for null."""
    return F.filter(F.split(F.coalesce(t, F.lit("")), SPACE), lambda x: x != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def letters(t: Column) -> Column:
    """Runs of letters in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def token_estimate(t: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(t, F.lit(""))) / 4).cast("int"))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12))


def keyword_hits(t: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur as substrings."""
    return once(F.lower(F.coalesce(t, F.lit(""))), lambda low: _hits(low, keywords))


def _hits(low: Column, keywords: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))


def any_of(t: Column, phrases: list[str]) -> Column:
    return once(F.lower(F.coalesce(t, F.lit(""))), lambda low: _hits(low, phrases) > 0)


def clean_path(p: Column) -> Column:
    return F.trim(F.replace(p, F.lit("\\"), F.lit("/")))


def sentences(t: Column) -> Column:
    """Pieces between white space that follows a full stop, question or exclamation mark; marks stay with their sentence."""
    return F.split(F.regexp_replace(F.coalesce(t, F.lit("")), r"([.!?])[ \t\r\n\f]+", "$1\u0001"), "\u0001")
