"""Review operators against small models written here."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomline.functions import answers, ids
from loomline.functions import text as T
from loomline.operators import graph, learning


@pytest.mark.parametrize("slice_rows", [1, 3, 1000])
def test_clipped_fold_over_slices(spark, slice_rows):
    rnd = random.Random(slice_rows)
    rows, want = [], {}
    for user in range(6):
        value, at = 10, datetime(2024, 1, 1)
        for i in range(rnd.choice([1, 40, 90])):
            at += timedelta(hours=rnd.choice([0, 1, 30]))
            step = rnd.choice([-4, -1, 0, 2, 5, None])
            value = min(20, max(0, value + (step or 0)))
            rows.append((user, user * 1000 + i, at, step))
        want[user] = value
    df = spark.createDataFrame(rows, "user_id int, event_id long, ts timestamp, step int").repartition(5)
    got = {r.user_id: r.value for r in learning.clipped_fold(df, ["user_id"], "step", 10, 0, 20, slice_rows).collect()}
    assert got == want
    assert learning.clipped_fold(df.limit(0), ["user_id"], "step", 10, 0, 20).count() == 0


def test_anchor_prefers_the_lower_case_spelling(spark):
    items = spark.createDataFrame([(1, "Salt", 0.9, "x"), (1, "Light", None, "x"), (1, "Sleep", 0.0, "x"), (2, "Salt", 0.9, "x"), (1, None, 0.9, "x")], "user_id int, topic string, difficulty double, theta string")
    known = spark.createDataFrame([(1, "salt", 0.2), (1, "Salt", 0.7), (1, "Light", 0.1)], "user_id int, topic string, theta double")
    got = {(r.user_id, r.topic): (r.known, r.anchor, round(r.gap, 6)) for r in learning.anchored(items.drop("theta"), known).collect()}
    assert got == {(1, "Salt"): (True, 0.2, 0.7), (1, "Light"): (True, 0.1, 0.4), (1, "Sleep"): (False, 0.5, 0.0), (2, "Salt"): (False, 0.5, 0.4), (1, None): (False, 0.5, 0.4)}


def test_neighbours_of_a_hub_equal_all_paths(spark):
    rnd = random.Random(3)
    edges = {}
    for i in range(40):
        edges[(f"n{i}", "increases", "hub")] = rnd.randint(2, 9)
        edges[("hub", rnd.choice(list(graph.RELATIONS)), f"n{rnd.randint(0, 39)}")] = rnd.randint(2, 9)
    for r in graph.RELATIONS:
        edges[("hub", r, "n1")] = 50  # the strongest way on leads back to n1 itself
    best = {}
    for (a, _, b), s in edges.items():
        for (c, r, e), t in edges.items():
            if b == c and a != e:
                key = (a, e, "indirect_" + r)
                best[key] = max(best.get(key, 0), round(s * t * 0.7, 4))
    best |= {(a, b, r): float(s) for (a, r, b), s in edges.items()}
    want = set()
    for node in {k[0] for k in best}:
        order = sorted((k for k in best if k[0] == node), key=lambda k: (-best[k], k[1], k[2]))
        want |= {(*k, best[k], i + 1) for i, k in enumerate(order[:5])}
    df = spark.createDataFrame([(a, r, b, s) for (a, r, b), s in edges.items()], "a string, relation string, b string, support long")
    assert {tuple(r) for r in graph.neighbours(df).select("node", "other", "relation", "strength", "rank").collect()} == want


def test_abstention_and_stripped_claims(spark):
    rows = [(1, "The sources do not cover this."), (2, "The premise is wrong. Salt helps."), (3, "Salt helps."), (4, None), (5, ""), (6, "Smith viewed it otherwise.")]
    df = spark.createDataFrame(rows, "id int, answer string")
    got = {r.id: (r.plain, r.named) for r in df.select("id", answers.abstention(F.col("answer")).alias("plain"), answers.abstention(F.col("answer"), "Smith").alias("named")).collect()}
    assert got == {1: ("abstained",) * 2, 2: ("premise_rejected",) * 2, 3: ("answered",) * 2, 4: ("answered",) * 2, 5: ("answered",) * 2, 6: ("answered", "premise_rejected")}
    texts = spark.createDataFrame([("One is so. Two is not! Three?", ["two IS not!"]), ("One is so. Two is not!", None), ("", ["x"]), (None, ["x"])], "a string, c array<string>")
    assert [r[0] for r in texts.select(answers.without_claims(F.col("a"), F.col("c"))).collect()] == ["One is so. Three?", "One is so. Two is not!", "", ""]
    assert spark.range(1).select(T.sentences(F.lit("A b.  C d?\n\nE"))).first()[0] == ["A b.", "C d?", "E"]


def test_expand_skips_a_phrase_inside_a_longer_one(spark):
    words = {"blood sugar": "glucose", "sugar": "sucrose", "low blood sugar": "hypoglycaemia", "salt": "sodium"}
    texts = ["Low blood sugar and salt", "blood sugar", "sugar only", "sugarcane", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(ids.expand(F.col("t"), words)).collect()] == ["Low blood sugar and salt (hypoglycaemia, sodium)", "blood sugar (glucose)", "sugar only (sucrose)", "sugarcane", None]
