"""Identifiers, links and small repairs of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def safe_id(raw: Column, limit: int = 64) -> Column:
    """Letters, digits, dot, hyphen and underscore only; a long id keeps its head and gets a hash of the whole."""
    s = F.regexp_replace(F.regexp_replace(F.translate(raw, ACCENTED, PLAIN), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 9), F.lit("_"), F.substring(F.md5(raw), 1, 8))).otherwise(s)


def link_reason(url: Column) -> Column:
    """Why a link can't be processed, or ``ok``."""
    u = F.lower(F.trim(url))
    return (
        F.when(u.isNull() | (u == ""), "empty").when(~u.rlike(r"^https?://"), "scheme").when(~u.rlike(r"^https?://[^/\s]+\.[^/\s]+"), "host")
        .when(u.rlike(r"\.(?:png|jpe?g|gif|mp3|mp4|zip)(?:[?#]|$)"), "media").otherwise("ok")
    )


def hash_vector(text: Column, dim: int) -> Column:
    """Offline stand-in for an embedding: the bytes of SHA-256 repeated to ``dim`` and brought to length 1."""
    # the hash is an element of an array, so that it is worked out once and not for each place
    hashes = F.array(F.sha2(F.coalesce(text, F.lit("")), 256))
    byte = lambda h, i: F.conv(F.substring(h, F.lit(2) * F.pmod(i, F.lit(32)) + F.lit(1), F.lit(2)), 16, 10).cast("double")
    raw = F.transform(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(h, i)))

    def unit(v: Column) -> Column:
        sizes = F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)))
        return F.transform(sizes, lambda s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))[0]

    return F.transform(raw, unit)[0]


def json_inside(text: Column, schema: str) -> Column:
    """The first JSON object in a text that may have fences or words around it; null if there is none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def first_reason(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the first rule whose phrase occurs, in order; null if none does."""
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    out = F.when(F.lit(False), F.lit(""))
    for phrase, reason in rules:
        out = out.when(F.contains(low, F.lit(phrase)), F.lit(reason))
    return out


def expand(text: Column, words: dict[str, str]) -> Column:
    """The text with the expansions of the phrases it holds in brackets after it, longest phrase first, each once. A phrase that is part
    of a longer one that the text holds is skipped."""
    low = F.lower(F.coalesce(text, F.lit("")))
    order = sorted(words, key=lambda p: (-len(p), p))
    held = lambda p: low.rlike(rf"(?:^|[^\p{{L}}]){p}(?:[^\p{{L}}]|$)")

    def alone(p: str) -> Column:
        longer = [held(q) for q in order if len(q) > len(p) and f" {p} " in f" {q} "]
        return reduce(lambda a, q: a & ~q, longer, held(p))

    hits = F.array(*[F.when(alone(p), F.lit(words[p])) for p in order])
    found = F.array_distinct(F.array_compact(hits))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(text, F.lit(" ("), F.concat_ws(", ", found), F.lit(")")))


def citation_drift(answer: Column, sources: Column) -> Column:
    """Numbers cited in brackets that are above the number of sources."""
    groups = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([0-9]+(?:, ?[0-9]+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, ", ?")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda x: x.cast("int")), lambda n: n > F.coalesce(sources, F.lit(0)))))
