"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F

from loomline.sources import readers, sinks


def test_text_scan_and_inventory(spark, tmp_path):
    (tmp_path / "x y").mkdir()
    (tmp_path / "x y" / "a.TXT").write_text("skip by glob")
    (tmp_path / "x y" / "b.txt").write_text("one two three")
    (tmp_path / "c.txt").write_text("one")
    got = {r.path: r.text for r in readers.corpus_files(spark, str(tmp_path), "*.txt", 2).collect()}
    assert got == {"x y/b.txt": "one two three"}
    inv = {r.path: (r.category, r.extension, r.bytes) for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert inv["c.txt"] == ("root", ".txt", 3) and inv["x y/a.TXT"][:2] == ("x y", ".txt")


def test_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\nbroken\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in readers.jsonl(spark, str(p), "a int, b string").collect()) == [1, 2]
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"questions": [{"id": "1", "n": 2}, {"id": "2"}]}, indent=1))
    assert sorted((r.id, r.n) for r in readers.json_list(spark, str(q), "questions", "id string, n int").collect()) == [("1", 2), ("2", None)]


def test_csv_casts(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,score,note\n1,2.5,"a ""b"""\n2,bad,\nx,1,z\n')
    got = [tuple(r) for r in readers.csv_typed(spark, str(p), {"id": "int", "score": "double", "note": "string"}, {"score": 0.0}).collect()]
    assert got == [(1, 2.5, 'a "b"'), (2, 0.0, None), (None, 1.0, "z")]


def test_missing_table_is_empty(spark, tmp_path):
    assert readers.parquet_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_html(spark):
    page = "<html><head><title>T &amp; x</title><script>bad()</script></head><body><nav>menu</nav><h1>Head</h1><p>One<br>two</p></body>"
    got = readers.html_pages(spark.createDataFrame([(1, page), (2, None), (3, "<p>open <b>x")], "id int, h string"), "id", "h").orderBy("id").collect()
    assert (got[0].title, got[0].text) == ("T & x", "Head\nOne\ntwo")
    assert got[1].text == "" and got[2].text == "open x"


def test_links_long(spark):
    df = spark.createDataFrame([(1, "u", None), (2, " ", "v")], "id int, l1 string, l2 string")
    assert sorted((r.id, r.slot, r.url) for r in readers.links_long(df, "id", ["l1", "l2"]).collect()) == [(1, "l1", "u"), (2, "l2", "v")]


def test_table_changes(spark, tmp_path):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "B", 2), (4, "d", 2), (4, "D", 3)], "k int, v string, ver int")
    merged = sinks.merge(now, new, "k", "ver")
    assert {r.k: r.v for r in merged.collect()} == {1: "a", 2: "B", 3: None, 4: "D"}
    assert sorted(r.k for r in sinks.delete(merged, new, "k").collect()) == [1, 3]
    assert sorted(r.k for r in sinks.delete_like(merged, "v", ["^a", "B$"]).collect()) == [3, 4]
    up = sinks.update(now, spark.createDataFrame([(1, "z"), (3, "y"), (9, "q")], "k int, v string"), "k")
    assert {r.k: r.v for r in up.collect()} == {1: "z", 2: "b", 3: "y"}
    assert sinks.with_columns(now, {"v": "string", "x": "double"}).columns == ["k", "v", "ver", "x"]
    place = str(tmp_path / "v")
    for _ in range(2):
        sinks.upsert_vectors(new, place, "k", 2)
    assert sinks.verify_count(spark, place, 2)


def test_summary(spark):
    s = sinks.summary(spark.createDataFrame([("a", 1), (None, 2), ("a", None)], "g string, v int"), "g", F.col("v")).first()
    assert (s.rows, s.groups, s.total, s.by_group) == (3, 2, 3, {"(none)": 1, "a": 2})
    e = sinks.summary(spark.createDataFrame([], "g string, v int"), "g", F.col("v")).first()
    assert (e.rows, e.groups, e.total) == (0, 0, 0)
