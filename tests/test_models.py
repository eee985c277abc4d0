"""Topic operators against small models written here."""

import math
import random
import re
import time
from collections import Counter

from loomline.operators import models


def terms(text):
    kept = [w for w in re.split(r"[^a-z]+", text.lower()) if len(w) >= 3 and w not in models.STOP]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)]


def test_vocabulary_of_long_texts(spark):
    """Words and pairs of a text are found in time proportional to its length: worked out for each word again, these take many minutes."""
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in ("bal", "dor", "fim", "gun", "hep", "the") for b in ("", "ka", "lo", "mi", "no", "re")]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) + "." for n in (20_000, 20_000, 0, 1, 2, 30, 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    df_of = Counter(t for text in [*texts, ""] for t in set(terms(text)))
    began = time.monotonic()
    got = {(r.term, r.df) for r in models.vocabulary(df).collect()}
    assert time.monotonic() - began < 60
    assert got == {(t, n) for t, n in df_of.items() if 2 <= n <= 0.6 * 8}


def test_topics_against_a_small_model(spark):
    """Clusters and mean weights of their terms as worked out here; two rows of one id count once each, a long text takes no longer than its length asks."""
    rnd = random.Random(4)
    groups = [[f"{a}{b}" for a in heads for b in ("ka", "lo", "mi", "no")] for heads in (("bal", "dor", "fim"), ("gun", "hep", "jir"))]
    texts = [(k // 2 % 40, k % 2, " ".join(rnd.choice(groups[k % 2]) for _ in range(10_000 if k < 2 else 40))) for k in range(90)]
    rows = [(2 * i + g, t) for i, g, t in texts]
    assert len({i for i, _ in rows}) == 80
    df = spark.createDataFrame([*rows, (200, None), (None, "balka"), (201, "the")], "doc_id long, text string")
    began = time.monotonic()
    clusters, weights = models.topics(df, ks=(2,), components=4)
    place = sorted((r.doc_id, r.cluster) for r in clusters.collect())
    got = {(r.term, r.cluster): r.weight for r in weights.collect()}
    assert time.monotonic() - began < 120
    of = {i % 2: c for i, c in place}
    assert of[0] != of[1] and place == sorted((i, of[i % 2]) for i, _ in rows)
    total = len(rows) + 1
    df_of = Counter(t for _, text in rows for t in set(terms(text)))
    idf = {t: math.log((total + 1) / (n + 1)) for t, n in df_of.items() if 2 <= n <= 0.6 * total}
    want = Counter()
    for i, text in rows:
        w = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
        for t, x in w.items():
            want[t, of[i % 2]] += x / math.sqrt(sum(v * v for v in w.values())) / (len(rows) // 2)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert models.topics(df.limit(0))[0].count() == 0
