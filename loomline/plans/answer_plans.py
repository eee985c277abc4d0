"""Queries on answers, batches, grounding and blended recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import answers as A
from loomline.functions import text as T
from loomline.operators import graph as G
from loomline.plans.corpus_plans import TECHNICAL, _kind, _KIND_SQL, _q
from loomline.plans.event_plans import _E, _events
from loomline.plans.graph_plans import _TRI
from loomline.plans.registry import query
from loomline.session import table


@query("""WITH c AS (SELECT DISTINCT id, answer, confidence, from_json(sources, '["VARCHAR"]') AS s FROM conversations WHERE json_valid(sources) AND answer IS NOT NULL)
SELECT id, md5(answer) AS body_md5, len(list_distinct(s)) AS sources, coalesce(confidence, 'none') AS confidence FROM c""")
def footer_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("id", "answer", "confidence", F.from_json("sources", "array<string>").alias("s")).filter("s IS NOT NULL AND answer IS NOT NULL").distinct()
    p = c.select("id", A.parse_footer(A.render_footer(F.col("answer"), F.col("s"), F.col("confidence"))).alias("p"))
    return p.select("id", F.md5("p.body").alias("body_md5"), F.size("p.sources").alias("sources"), F.col("p.confidence").alias("confidence"))


@query()
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed paragraph by paragraph into batches of 2,000 characters."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), lambda p: F.length(p) > 0)
    b = table(spark, d, "documents").select("doc_id", A.pack(parts, 2000).alias("b"))
    return b.select("doc_id", F.size("b").alias("batches"), F.coalesce(F.array_max("b"), F.lit(0)).alias("largest"))


_STOPS = ", ".join(map(_q, G.STOP))


def _grounded_sql(e: str) -> str:
    words = rf"list_filter(string_split_regex(lower({e}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOPS}))"
    return f"(len({words}) = 0 OR len(list_filter({words}, lambda w: contains(lower(coalesce(context, '')), w))) > 0)"


@query(f"""WITH {_TRI}, r AS (SELECT id, max(context) AS context FROM search_results GROUP BY id)
SELECT relation, {_grounded_sql("subject")} AND {_grounded_sql("object")} AS grounded, count(*) AS triples FROM tri JOIN r USING (id) GROUP BY 1, 2""")
def triple_grounding(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "search_results")
    tri = G.triples(s, "id", "ray_peat_response")
    r = s.groupBy("id").agg(F.max("context").alias("context"))
    ok = A.grounded(F.col("subject"), F.col("context"), G.STOP) & A.grounded(F.col("object"), F.col("context"), G.STOP)
    return tri.join(r, "id").groupBy("relation", ok.alias("grounded")).agg(F.count("*").alias("triples"))


@query(f"""WITH {_E}, pop AS (SELECT item, count(*)::DOUBLE / (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY item)) AS pop FROM e GROUP BY item),
own AS (SELECT user_id, topic, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2), share AS (SELECT user_id, topic, c / sum(c) OVER (PARTITION BY user_id) AS share FROM own),
cand AS (SELECT s.user_id, p.item, round(0.7 * p.pop + 0.3 * s.share, 6) AS score FROM share s JOIN pop p ON p.item % 10 = s.topic),
new AS (SELECT * FROM cand ANTI JOIN (SELECT DISTINCT user_id, item FROM e) USING (user_id, item))
SELECT user_id, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM new) WHERE rank <= 3""")
def rec_blend(spark: SparkSession, d: str) -> DataFrame:
    """Popularity and the user's share of the topic, over items not yet used. Of a topic a user meets only the most popular items, three more than
    they have used."""
    e = _events(spark, d)
    counts = e.groupBy("item").agg(F.count("*").alias("c"))
    most = counts.agg(F.max("c").alias("most"))
    pop = counts.join(F.broadcast(most)).select("item", (F.col("item") % 10).alias("topic"), (F.col("c").cast("double") / F.col("most")).alias("pop"))
    placed = pop.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("pop"), "item")))
    own = e.groupBy("user_id", "topic").agg(F.count("*").cast("double").alias("c"), F.countDistinct("item").alias("used"))
    share = own.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy("user_id")))
    asked = share.withColumn("place", F.explode(F.sequence(F.lit(1), (F.col("used") + 3).cast("int"))))  # three are left once the user's own are out
    cand = asked.join(placed, ["topic", "place"]).select("user_id", "item", F.round(0.7 * F.col("pop") + 0.3 * F.col("share"), 6).alias("score"))
    new = cand.join(e.select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item"))).filter("rank <= 3")


@query(f"""WITH c AS (SELECT DISTINCT doc_id FROM chunk_metadata) SELECT coalesce(kind, 'all') AS kind, count(*) AS documents, count(c.doc_id) AS done, round(100.0 * count(c.doc_id) / count(*), 4) AS pct
FROM (SELECT doc_id, {_KIND_SQL.format("source")} AS kind FROM documents) d LEFT JOIN c USING (doc_id) GROUP BY ROLLUP (kind)""")
def progress_by_kind(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "chunk_metadata").select("doc_id", F.lit(1).alias("done")).distinct()
    j = table(spark, d, "documents").select("doc_id", _kind("source").alias("kind")).join(done, "doc_id", "left")
    return j.rollup("kind").agg(F.count("*").alias("documents"), F.count("done").alias("done"), F.round(100.0 * F.count("done") / F.count("*"), 4).alias("pct")).withColumn("kind", F.coalesce("kind", F.lit("all")))


@query()
def jargon_terms(spark: SparkSession, d: str) -> DataFrame:
    """Technical words of the logged questions, and near misses such as misspellings."""
    c = table(spark, d, "conversations").select("id", "question").distinct().select("id", T.letters(F.col("question")).alias("words"))
    return A.jargon(c, "id", "words", TECHNICAL).groupBy("exact", "fuzzy").agg(F.count("*").alias("rows"))


@query("""WITH l AS (SELECT DISTINCT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT doc_id, chunk_id, start_pos, end_pos FROM chunk_metadata),
o AS (SELECT c.*, n, lag(end_pos) OVER (PARTITION BY c.doc_id ORDER BY chunk_id) AS before, lead(start_pos) OVER (PARTITION BY c.doc_id ORDER BY chunk_id) AS after FROM c JOIN l USING (doc_id))
SELECT count(*) AS pieces, count(*) FILTER (WHERE before IS NOT NULL AND start_pos < before) AS overlapping, count(*) FILTER (WHERE before IS NOT NULL AND start_pos > before) AS with_gap, count(*) FILTER (WHERE after IS NULL AND end_pos < n) AS cut_short, coalesce(sum(greatest(before - start_pos, 0)), 0)::BIGINT AS overlap_chars FROM o""")
def chunk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps and gaps between neighbouring earlier cuts."""
    n = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length("text").alias("n")).distinct()
    c = table(spark, d, "chunk_metadata").select("doc_id", "chunk_id", "start_pos", "end_pos").distinct().join(n, "doc_id")
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    o = c.withColumn("before", F.lag("end_pos").over(w)).withColumn("after", F.lead("start_pos").over(w))
    return o.agg(
        F.count("*").alias("pieces"), F.count_if(F.col("start_pos") < F.col("before")).alias("overlapping"), F.count_if(F.col("start_pos") > F.col("before")).alias("with_gap"),
        F.count_if(F.col("after").isNull() & (F.col("end_pos") < F.col("n"))).alias("cut_short"), F.coalesce(F.sum(F.greatest(F.col("before") - F.col("start_pos"), F.lit(0))), F.lit(0)).cast("bigint").alias("overlap_chars"),
    )


@query("""WITH c AS (SELECT DISTINCT id, coalesce(question, '') AS q FROM conversations), l AS (SELECT id, lower(q) AS q FROM c)
SELECT CASE WHEN regexp_matches(q, '\\b(salt|thyroid|sugar|pulse|sleep|milk|schlaf|sommeil|sel|salz|leche)') THEN 'inside' WHEN regexp_matches(q, '\\b(football|stock|python|election|weather)') THEN 'outside' ELSE 'open' END AS domain, count(*) AS rows FROM l GROUP BY 1""".replace("\\\\", "\\"))
def domain_gate(spark: SparkSession, d: str) -> DataFrame:
    """Words of the domain win over words outside it; neither leaves the row open."""
    q = F.lower(F.coalesce("question", F.lit("")))
    gate = F.when(q.rlike(r"\b(salt|thyroid|sugar|pulse|sleep|milk|schlaf|sommeil|sel|salz|leche)"), "inside").when(q.rlike(r"\b(football|stock|python|election|weather)"), "outside").otherwise("open")
    return table(spark, d, "conversations").select("id", "question").distinct().groupBy(gate.alias("domain")).agg(F.count("*").alias("rows"))


@query()
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Calls let through and refused per asker, three in any hour."""
    from loomline.operators.dialogue import event_time
    from loomline.streaming.state import limited

    c = table(spark, d, "conversations").select("id", "ts", F.col("ip_hash").alias("key")).distinct().select("key", "id", F.unix_micros(event_time(F.col("ts"))).alias("us"))
    return limited(c, 3, 3600).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT q.id AS qid, e.id, e.label = q.label AS same, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.id % 100 = 0 AND q.id <> e.id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM k) WHERE rank <= 50)
SELECT qid, id, label, score FROM (SELECT qid, id, CASE WHEN same THEN 1 ELSE 0 END AS label, score, row_number() OVER (PARTITION BY qid, same ORDER BY rank) AS r FROM t) WHERE r = 1""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """(query, passage, label): the nearest of the same and of another label among 50 neighbours."""
    from loomline.plans.vector_plans import _knn50

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    t = _knn50(spark, d).join(e, "id").join(e.select(F.col("id").alias("qid"), F.col("label").alias("ql")), "qid").withColumn("label", (F.col("label") == F.col("ql")).cast("int"))
    w = Window.partitionBy("qid", "label").orderBy("rank")
    return t.withColumn("r", F.row_number().over(w)).filter("r = 1").select("qid", "id", "label", "score")


@query("""WITH r AS (SELECT context, min(id) AS first_id, count(DISTINCT id) AS passages, max(similarity_score) AS best FROM search_results WHERE length(context) > 10 AND length(context) <= 1000 GROUP BY context)
SELECT md5(context) AS context_md5, first_id, passages, best FROM r ORDER BY best DESC NULLS LAST, first_id LIMIT 100""")
def related_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Unique contexts, the best first; a top-k report."""
    s = table(spark, d, "search_results").filter(F.length("context").between(11, 1000))
    r = s.groupBy("context").agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("passages"), F.max("similarity_score").alias("best"))
    return r.orderBy(F.desc_nulls_last("best"), "first_id").limit(100).select(F.md5("context").alias("context_md5"), "first_id", "passages", "best")


@query("""SELECT source_file, count(DISTINCT id) AS passages, max(similarity_score) AS best_score, round(sum(CASE WHEN context IS NULL OR context = '' THEN 0 ELSE 1 END) / count(*)::DOUBLE, 6) AS completeness,
CASE WHEN sum(CASE WHEN context IS NULL OR context = '' THEN 0 ELSE 1 END) / count(*)::DOUBLE > 0.95 THEN 'good' WHEN sum(CASE WHEN context IS NULL OR context = '' THEN 0 ELSE 1 END) / count(*)::DOUBLE > 0.8 THEN 'fair' ELSE 'poor' END AS health
FROM (SELECT *, replace(source_file, '\\', '/') AS f FROM search_results) GROUP BY source_file""".replace("\\\\", "\\"))
def file_health(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of contexts per file, with a grade."""
    has = F.sum(F.when(F.coalesce("context", F.lit("")) != "", 1).otherwise(0)) / F.count("*")
    g = table(spark, d, "search_results").groupBy("source_file").agg(F.countDistinct("id").alias("passages"), F.max("similarity_score").alias("best_score"), has.alias("h"))
    return g.select("source_file", "passages", "best_score", F.round("h", 6).alias("completeness"), F.when(F.col("h") > 0.95, "good").when(F.col("h") > 0.8, "fair").otherwise("poor").alias("health"))
