"""Operators against small models written here."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import ids
from loomline.functions import text as T
from loomline.operators import corpus, dialogue, graph, learning, relational, vector
from loomline.streaming.state import elo_step, expected


def greedy(rows, k, per_file=2, fp=0.3, tp=0.05):
    """Diversified selection, one by one."""
    left, out, nf, nt = sorted(rows, key=lambda r: (-r[3], r[0])), [], {}, {}
    while left and len(out) < k:
        left = [r for r in left if nf.get(r[1], 0) < per_file]
        if not left:
            break
        best = min(left, key=lambda r: (-round(round(r[3] - fp * nf.get(r[1], 0), 6) - tp * nt.get(r[2], 0), 6), r[0]))
        left.remove(best)
        out.append(best[0])
        nf[best[1]] = nf.get(best[1], 0) + 1
        nt[best[2]] = nt.get(best[2], 0) + 1
    return out


def test_diversify_is_greedy(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for case in range(60):
        own = []
        for i in range(rnd.randint(1, 14)):
            kind = f"k{rnd.randint(0, 2)}"
            own.append((case * 100 + i, f"{kind}/{rnd.randint(0, 3)}", kind, round(rnd.random(), 2)))
        want[case] = greedy(own, 6)
        rows += [(case, *r) for r in own]
    df = spark.createDataFrame(rows, "q int, id long, file string, kind string, score double")
    got = {}
    for r in vector.diversify(df, 6, by=("q",)).orderBy("q", "pos").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got == want


def test_knn_join_blocks_are_exact(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8)).round(3)
    m[7] = 0
    corpus_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, vec array<double>")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(10)], "qid long, vec array<double>")
    got = {(r.qid, r.rank): r.id for r in vector.knn_join(corpus_df, q, 4, True, query_block=3, corpus_block=5).collect()}
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    for i in range(10):
        s = np.round(u[i] @ u.T, 6)
        best = sorted((j for j in range(60) if j != i), key=lambda j: (-s[j], j))[:4]
        assert [got[(i, k + 1)] for k in range(4)] == best


def test_predicate_rejects_unknown_operators():
    with pytest.raises(ValueError):
        vector.predicate({"a": {"$regex": "x"}})


def test_hard_negatives_beyond_any_neighbourhood(spark, tmp_path):
    """A query whose nearest 299 rows all have its own label still gets its negative."""
    from loomline.plans.evaluate_plans import hard_negatives

    rows = [(i, 0, [1.0, i / 1000]) for i in range(300)] + [(300, 1, [0.0, 1.0]), (301, 1, [-1.0, 0.0]), (400, None, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.qid: (r.positive, r.negative) for r in hard_negatives(spark, str(tmp_path)).collect()}
    assert got == {0: (1, 300), 100: got[100], 200: got[200], 300: (301, 299), 400: (None, None)}
    assert got[100][1] == got[200][1] == 300 and got[100][0] in (99, 101)


def test_empty_vectors(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    assert vector.search(e, q, 5).count() == 0
    assert vector.knn_join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), 3).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([0.0, 1.0])), min_size=1, max_size=30))
def test_ema_closed_form(spark, events):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(u, start + timedelta(hours=7 * i), i, p) for i, (u, p) in enumerate(events)], "user_id long, ts timestamp, event_id long, p double")
    want = {}
    for u, p in events:
        want[u] = 0.9 * want.get(u, 0.5) + 0.1 * p
    got = {r.user_id: r.ema for r in learning.ema(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 2e-6 for u in got)


def test_sessions_across_days(spark):
    rnd = random.Random(4)
    at = datetime(2024, 1, 1, 20)
    rows, want = [], []
    for i in range(200):
        step = rnd.choice([1, 50, 200, 359, 360, 361, 900, 2000])
        if i and step <= 360:
            at += timedelta(minutes=step)
            want[-1] = (want[-1][0], at, want[-1][2] + 1)
        else:
            at += timedelta(minutes=step if i else 0)
            want.append((at, at, 1))
        rows.append((1, at, i))
    got = learning.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")).orderBy("session_no").collect()
    assert [(r.start, r.end, r.events) for r in got] == want
    assert [r.session_no for r in got] == list(range(1, len(want) + 1))


def test_upper_median_and_ties(spark):
    rows = [("a", x) for x in (1, 1, 1, 5, 9, 9)] + [("b", 4), ("b", None)]
    got = {r.g: r.upper_median for r in corpus.upper_median(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()}
    assert got == {"a": 5, "b": 4}


def test_overlap_join_is_exact(spark):
    rnd = random.Random(1)
    words = "abcdefghij"
    left = [(i, [rnd.choice(words) for _ in range(rnd.randint(1, 5))]) for i in range(40)]
    right = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 6))]) for i in range(40)]
    want = {(i, j) for i, a in left for j, b in right if len(set(a) & set(b)) / len(set(a)) > 0.6}
    got = {(r.lid, r.rid) for r in corpus.overlap_join(spark.createDataFrame(left, "lid int, words array<string>"), spark.createDataFrame(right, "rid int, words array<string>"), 0.6).collect()}
    assert got == want


def test_first_of_each_keeps_short_ones(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yyyy"), (4, "yyyy"), (5, None)], "id int, k string")
    got = sorted((r.first, r.copies) for r in corpus.first_of_each(df, F.col("k"), "id", F.length("k") <= 1).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (5, 1)]


def test_marked_parts(spark):
    docs = [("a", "**X:** one\n**C:** ctx\n**X:** two"), ("b", "**C:** before **X:** said"), ("c", "no markers"), ("d", None)]
    got = sorted((r.id, r.chunk_index, r.text, r.context) for r in corpus.marked_parts(spark.createDataFrame(docs, "id string, t string"), "id", "t", "X", "C").collect())
    assert got == [("a", 0, "one", "ctx"), ("a", 1, "two", "ctx"), ("b", 0, "said", "before")]


@pytest.mark.parametrize("text,kind", [("Hi!", "greeting"), ("  ", "greeting"), ("!!!", "greeting"), (None, "greeting"), ("thanks", "thanks"), ("Merci !", "thanks"), ("hi what is salt", None), ("thanks to salt I sleep", None)])
def test_small_talk(spark, text, kind):
    assert spark.createDataFrame([(text,)], "q string").select(dialogue.small_talk(F.col("q")).alias("k")).first().k == kind


def test_gibberish(spark):
    rows = spark.createDataFrame([("aaaaah",), ("xkcd zzz",), ("bcdfgh",), ("What is salt?",), (None,), ("",)], "q string")
    assert [r.g for r in rows.select(dialogue.gibberish(F.col("q")).alias("g")).collect()] == [True, True, True, False, False, False]


def test_event_time_forms(spark):
    rows = spark.createDataFrame([("2025-03-01T00:03:17.5",), ("2025-03-01 00:03:17.5+00:00",), (" 2025-03-01T01:03:17.5+01:00",), ("bad",), (None,)], "t string")
    got = [r.t for r in rows.select(F.unix_micros(dialogue.event_time(F.col("t"))).alias("t")).collect()]
    assert got[0] == got[1] == got[2] and got[3:] == [None, None]


def test_pairs_in_window(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"],), ([],), (None,)], "t array<string>")
    got = {(r.a, r.b): r.n for r in graph.pairs_in_window(df, "t", 3).collect()}
    assert got == {("a", "b"): 2, ("b", "c"): 1, ("a", "c"): 1}


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 5), (3, "v", 9), (4, None, 9), (5, "u", 3)], "id int, k string, t int")
    right = spark.createDataFrame([("u", 4, "x"), ("u", 5, "y"), ("u", None, "z"), ("w", 1, "q")], "k string, rt int, v string")
    got = {r.id: r.v for r in relational.as_of_join(left, right, "k", "t", "rt", ["v"]).collect()}
    assert got == {1: "y", 2: "y", 3: None, 4: None, 5: None}
    for step in (1, 2, 4):
        sliced = {r.id: r.v for r in relational.as_of_join(left, right, "k", "t", "rt", ["v"], lambda t, step=step: F.floor(t / step)).collect()}
        assert sliced == got


def test_history_across_days(spark):
    rnd = random.Random(3)
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(120):
        at += timedelta(hours=rnd.choice([0, 1, 5, 30]))
        rows.append((i, rnd.choice(["a", "a", "b", None]), f"q{i} it ", at))
    log = spark.createDataFrame(rows, "id long, ip_hash string, question string, at timestamp")
    seen, want, before = {}, {}, {}
    for i, ip, q, _ in rows:
        own = seen.setdefault(ip or f"row {i}", [])
        want[i], before[i] = " / ".join(own[-4:]), own[-1] if own else None
        own.append(q)
    assert {r.id: r.history for r in dialogue.history(log).collect()} == want
    assert {r.id: r.resolved for r in dialogue.resolve(log).collect()} == {i: f"{before[i]} — {q}" if before[i] else q for i, _, q, _ in rows}


def test_range_join(spark):
    rnd = random.Random(2)
    a = [(i, rnd.randint(0, 1), rnd.randint(-50, 50)) for i in range(40)]
    b = [(i, rnd.randint(0, 1), rnd.randint(-50, 50)) for i in range(40)]
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= 7}
    got = [(r.i, r.j) for r in relational.range_join(spark.createDataFrame(a, "i int, k int, p int"), spark.createDataFrame(b, "j int, k int, q int"), "k", "p", "q", 7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_elo():
    assert math.isclose(expected(0.5, 0.5), 0.5)
    theta = 0.5
    for _ in range(500):
        theta = elo_step(theta, -3.0, 1.0)
    assert 0.5 < theta <= 3.0
    assert elo_step(-3.0, 3.0, 0.0) == -3.0


def test_fingerprint_and_words(spark):
    df = spark.createDataFrame([("  Ça  va,\tbien! ",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(T.fingerprint(F.col("t")).alias("f"), T.word_count(F.col("t")).alias("n")).collect()]
    assert got == [("ça va bien", 3), (None, 0), ("", 0)]


def test_ids(spark):
    df = spark.createDataFrame([("Éa b/c",), ("x" * 100,), (None,)], "s string")
    got = [r.i for r in df.select(ids.safe_id(F.col("s")).alias("i")).collect()]
    assert got[0] == "Ea_b_c" and len(got[1]) == 64 and got[2] is None
    j = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("none",), ('x {"a": bad} y',)], "t string")
    assert [r.j and r.j.a for r in j.select(ids.json_inside(F.col("t"), "a int").alias("j")).collect()][:1] == [1]
    v = spark.createDataFrame([("abc",), (None,)], "t string").select(ids.hash_vector(F.col("t"), 40).alias("v")).collect()
    assert all(len(r.v) == 40 and abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in v)


def test_pack_is_greedy(spark):
    from loomline.functions import answers

    rnd = random.Random(6)
    rows, want = [], []
    for i in range(50):
        parts = ["x" * rnd.randint(1, 30) for _ in range(rnd.randint(0, 12))]
        out, now = [], 0
        for p in parts:
            if now and now + len(p) > 25:
                out.append(now)
                now = 0
            now += len(p)
        rows.append((i, parts))
        want.append(out + [now] * (now > 0))
    got = spark.createDataFrame(rows, "i int, p array<string>").select("i", answers.pack(F.col("p"), 25).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == want


def test_footer_without_footer(spark):
    from loomline.functions import answers

    r = spark.createDataFrame([("plain answer",), (None,)], "t string").select(answers.parse_footer(F.col("t")).alias("p")).collect()
    assert (r[0].p.body, r[0].p.sources, r[0].p.confidence) == ("plain answer", [], None) and r[1].p.body is None


def test_jargon(spark):
    from loomline.functions import answers

    df = spark.createDataFrame([(1, ["thyroid", "thyriod", "salt"]), (2, None), (3, [])], "id int, w array<string>")
    got = sorted(tuple(r) for r in answers.jargon(df, "id", "w", ["thyroid", "cortisol"]).collect())
    assert got == [("1", 1, 1), ("2", 0, 0), ("3", 0, 0)]


def test_limiter_refusals_do_not_count(spark):
    from loomline.streaming.state import limited

    rnd = random.Random(8)
    calls = [(f"k{rnd.randint(0, 2)}", i, rnd.randint(0, 400) * 1_000_000) for i in range(200)] + [(None, 900, 1), ("k0", 901, None)]
    want, let = {}, {}
    for k, i, us in sorted((c for c in calls if None not in c), key=lambda c: (c[0], c[2], c[1])):
        recent = [t for t in let.get(k, []) if t > us - 60_000_000]
        want[i] = len(recent) < 3
        let[k] = recent + [us] * want[i]
    got = {r.id: r.allowed for r in limited(spark.createDataFrame(calls, "key string, id long, us long"), 3, 60).collect()}
    assert got == want


def test_ema_update_over_several_chunks(spark):
    """More rows of one user in a batch than one chunk holds, in any order and in two files: folded in order of time."""
    import datetime as dt

    from loomline.streaming import events as S

    rnd = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(7 if k % 10 else 8, start + dt.timedelta(seconds=k), k, float(rnd.random() < 0.5)) for k in range(24_000)]
    rnd.shuffle(rows)
    from loomline.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    place = spark.sparkContext._jsc.sc().getCheckpointDir().get() + "/ema-test"
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, p double").coalesce(1).repartition(2).write.mode("overwrite").parquet(place)
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long, p double").parquet(place)
    got = {r.user_id: r for r in S.latest(S.run_to_end(S.running_ema(stream), "update"), "user_id", "n").collect()}
    for user in (7, 8):
        value = 0.5
        own = sorted(r for r in rows if r[0] == user)
        for *_, p in own:
            value = 0.9 * value + 0.1 * p
        assert got[user].n == len(own) and abs(got[user].ema - value) < 1e-5


@pytest.mark.parametrize(
    "question,want",
    [("hellllo there", True), ("what is asdfghjk salt", True), ("sdfds qwrtz", True), ("is salt good", False), ("rhythm of sleep", False), ("aaaa", True), ("!!!", True), ("why    salt", True), ("thyroid strengths", True), ("good strength", False), (None, True)],
)
def test_gibberish(spark, question, want):
    from loomline.operators.dialogue import gibberish

    assert spark.createDataFrame([(question,)], "q string").select(gibberish(F.col("q"))).first()[0] is want
