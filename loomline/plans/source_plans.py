"""Queries on sources, sinks and identifiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import ids
from loomline.plans.corpus_plans import _q
from loomline.plans.registry import query
from loomline.session import ensure_checkpoint_dir, table
from loomline.sources import readers, sinks


def _place(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


@query("SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark)
    sinks.append_jsonl(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), place, F.col("ts"))
    back = readers.jsonl(spark, place, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string, day string")
    return back.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT doc_id, length(coalesce(text, '')) AS chars, coalesce(n_chars, -1) AS n_chars, md5(coalesce(title, '')) AS title_md5 FROM documents")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    place = _place(spark)
    docs = table(spark, d, "documents").select("doc_id", F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text"), "n_chars", F.coalesce("title", F.lit("")).alias("title"))
    sinks.write_csv(docs, place)
    back = readers.csv_typed(spark, place, {"doc_id": "bigint", "text": "string", "n_chars": "bigint", "title": "string"}, {"n_chars": -1})
    text = F.decode(F.unbase64(F.coalesce("text", F.lit(""))), "UTF-8")
    return back.select("doc_id", F.length(text).alias("chars"), "n_chars", F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"))


@query("""SELECT vec_id, label + 100 AS label, 'new' AS state FROM embeddings WHERE vec_id % 5 = 0 AND label <> 3 UNION ALL SELECT vec_id, label, 'old' FROM embeddings WHERE vec_id % 5 <> 0 AND label <> 3""")
def merge_delete_update(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    now = e.withColumn("state", F.lit("old")).withColumn("version", F.lit(1))
    changes = e.filter("vec_id % 5 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit("new").alias("state"), F.lit(2).alias("version"))
    return sinks.delete(sinks.merge(now, changes, "vec_id", "version"), e.filter("label = 3"), "vec_id").select("vec_id", "label", "state")


@query("SELECT count(*) AS rows, count(DISTINCT coalesce(event_type, '(none)')) AS groups, round(sum(value), 2) AS total FROM events")
def summary_row(spark: SparkSession, d: str) -> DataFrame:
    return sinks.summary(table(spark, d, "events"), "event_type", F.col("value")).select("rows", "groups", F.round("total", 2).alias("total"))


_ACC, _PL = ids.ACCENTED, ids.PLAIN
_SAFE = rf"regexp_replace(regexp_replace(translate(source_file, '{_ACC}', '{_PL}'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"SELECT DISTINCT source_file, CASE WHEN length({_SAFE}) > 64 THEN substr({_SAFE}, 1, 55) || '_' || substr(md5(source_file), 1, 8) ELSE {_SAFE} END AS safe FROM search_results")
def safe_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_results").select("source_file", ids.safe_id(F.col("source_file")).alias("safe")).distinct()


_URL = r"([a-z]+://[^\s<>\"]+)"


@query(rf"""WITH u AS (SELECT doc_id, lower(trim(unnest(regexp_extract_all(coalesce(text, ''), {_q(_URL)}, 1)))) AS u FROM documents)
SELECT CASE WHEN u = '' THEN 'empty' WHEN NOT regexp_matches(u, '^https?://') THEN 'scheme' WHEN NOT regexp_matches(u, '^https?://[^/\s]+\.[^/\s]+') THEN 'host' WHEN regexp_matches(u, '\.(?:png|jpe?g|gif|mp3|mp4|zip)(?:[?#]|$)') THEN 'media' ELSE 'ok' END AS reason, count(*) AS links FROM u GROUP BY 1""")
def link_reasons(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_URL), F.lit(1))).alias("u"))
    return u.groupBy(ids.link_reason(F.col("u")).alias("reason")).agg(F.count("*").alias("links"))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), b AS (SELECT doc_id, list_transform(range(0, 64), lambda i: (instr('0123456789abcdef', substr(h, 2 * (i % 32) + 1, 1)) - 1) * 16.0 + instr('0123456789abcdef', substr(h, 2 * (i % 32) + 2, 1)) - 1)::DOUBLE[] AS v FROM h)
SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last, len(v) AS dim FROM b""")
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", ids.hash_vector(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.size("v").alias("dim"))


@query(r"""WITH c AS (SELECT DISTINCT id, answer, n_sources FROM conversations), g AS (SELECT id, coalesce(n_sources, 0) AS n, flatten(list_transform(regexp_extract_all(coalesce(answer, ''), '\[([0-9]+(?:, ?[0-9]+)*)\]', 1), lambda x: string_split_regex(x, ', ?'))) AS t FROM c),
k AS (SELECT id, len(list_distinct(list_filter(list_transform(t, lambda x: x::INT), lambda x: x > n))) AS drift FROM g) SELECT drift, count(*) AS rows FROM k GROUP BY drift""")
def citation_drift(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("id", "answer", "n_sources").distinct()
    return c.select(F.size(ids.citation_drift(F.col("answer"), F.col("n_sources"))).alias("drift")).groupBy("drift").agg(F.count("*").alias("rows"))


_GATE = [(" grams ", "dose"), (" gramm ", "dose"), (" grammes ", "dose"), (" gramos ", "dose"), ("who is right", "dispute"), (" weeks ", "course"), (" wochen", "course"), (" semaines", "course"), (" semanas", "course"), ("why ", "cause"), ("pourquoi", "cause"), ("warum", "cause"), ("por qué", "cause")]


@query(f"SELECT coalesce(reason, 'other') AS reason, count(*) AS rows FROM (SELECT CASE {' '.join(f'WHEN contains(q, {_q(p)}) THEN {_q(r)}' for p, r in _GATE)} END AS reason FROM (SELECT DISTINCT id, ' ' || lower(coalesce(question, '')) || ' ' AS q FROM conversations)) GROUP BY 1")
def ordered_gate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("id", F.lower(F.coalesce("question", F.lit(""))).alias("q")).distinct()
    return c.groupBy(F.coalesce(ids.first_reason(F.col("q"), _GATE), F.lit("other")).alias("reason")).agg(F.count("*").alias("rows"))


_EXPAND = {"blood sugar": "glucose", "table salt": "sodium", "morning light": "daylight", "slow metabolism": "low basal rate", "thyroid gland": "thyroid", "stress reaction": "cortisol"}
_ORDER = sorted(_EXPAND, key=lambda p: (-len(p), p))
_FOUND = f"list_distinct(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(question), {_q(rf'(?:^|[^\p{{L}}]){p}(?:[^\p{{L}}]|$)')}) THEN {_q(_EXPAND[p])} END' for p in _ORDER)}], lambda x: x IS NOT NULL))"


@query(f"WITH c AS (SELECT DISTINCT id, question FROM conversations WHERE question IS NOT NULL), f AS (SELECT id, question, {_FOUND} AS f FROM c) SELECT id, len(f) AS added, length(CASE WHEN len(f) = 0 THEN question ELSE question || ' (' || array_to_string(f, ', ') || ')' END) AS chars FROM f")
def expand_questions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("question IS NOT NULL").select("id", "question").distinct().withColumn("x", ids.expand(F.col("question"), _EXPAND))
    added = F.when(F.col("x") == F.col("question"), 0).otherwise(F.size(F.split(F.expr("substring(x, length(question) + 1)"), ", ")))
    return c.select("id", added.alias("added"), F.length("x").alias("chars"))


@query("SELECT source, count(*) AS documents FROM documents WHERE ingested_at > (SELECT max(ingested_at) FROM documents) - INTERVAL 7 DAY GROUP BY source")
def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "ingested_at")
    last = docs.agg(F.max("ingested_at").alias("last"))
    return docs.join(F.broadcast(last)).filter(F.col("ingested_at") > F.col("last") - F.expr("INTERVAL 7 DAYS")).groupBy("source").agg(F.count("*").alias("documents"))
