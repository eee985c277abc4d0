"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.vectors import cosine, fit, norm
from loomline.operators import vector as V
from loomline.plans.registry import query
from loomline.session import table

_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").filter("vec_id <> 0")
    return e.join(F.broadcast(_query_vector(spark, d).limit(1))).select(
        F.col("vec_id").alias("id"), F.concat_ws("/", "label", F.pmod("vec_id", F.lit(7))).alias("file"), F.col("label").cast("string").alias("kind"), "label", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")
    )


_SCORED = f"""scored AS (SELECT e.vec_id AS id, e.label || '/' || (e.vec_id % 7) AS file, e.label::VARCHAR AS kind, e.label, {_COS} AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0)"""


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10")
def knn_topk_single(spark: SparkSession, d: str) -> DataFrame:
    return V.search(table(spark, d, "embeddings"), _query_vector(spark, d), 10)


_KNN = f"""SELECT * FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 {{}}) WHERE rank <= 10"""


def _knn50(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, True, 50)


def _knn(spark: SparkSession, d: str, exclude: bool, k: int = 10) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.knn_join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), k, exclude)


@query(_KNN.format(""))
def knn_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, False)


@query(_KNN.format("AND q.vec_id <> e.vec_id"))
def knn_self_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, True)


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (0,1,2,3,4,5) AND e.label NOT IN (3) AND {_COS} >= 0.1 ORDER BY score DESC, vec_id LIMIT 20")
def vec_filter_in_nin(spark: SparkSession, d: str) -> DataFrame:
    return V.search(table(spark, d, "embeddings"), _query_vector(spark, d), 20, 0.1, {"label": {"$in": [0, 1, 2, 3, 4, 5], "$nin": [3]}})


@query("SELECT vec_id, label, 0.0::DOUBLE AS score FROM embeddings WHERE label = 4 ORDER BY vec_id LIMIT 100")
def metadata_only_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter(V.predicate({"label": 4})).select("vec_id", "label", F.lit(0.0).alias("score")).orderBy("vec_id").limit(100)


@query(f"""WITH {_SCORED.replace("e.label || '/' || (e.vec_id % 7) AS file", "e.label::VARCHAR AS file")},
top AS (SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 80) WHERE score >= 0.15),
cnt AS (SELECT file, count(*) AS n FROM top GROUP BY file),
more AS (SELECT * FROM (SELECT * FROM scored WHERE file NOT IN (SELECT file FROM cnt WHERE n >= 4) ORDER BY score DESC, id LIMIT 40) WHERE score >= 0.15 AND (SELECT count(*) < 6 AND max(n) >= 4 FROM cnt)),
u AS (SELECT id, file, score FROM top UNION SELECT id, file, score FROM more)
SELECT * FROM (SELECT id, file, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS file_rank FROM u) WHERE file_rank <= 4""")
def two_pass_capped(spark: SparkSession, d: str) -> DataFrame:
    return V.two_pass(_scored(spark, d).withColumn("file", F.col("label").cast("string")))


_DIVERSE = """f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS rf FROM c),
a AS (SELECT *, round(score - 0.3 * (rf - 1), 6) AS a FROM f WHERE rf <= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY a DESC, id) AS rt FROM a),
b AS (SELECT *, round(a - 0.05 * (rt - 1), 6) AS b FROM t)
SELECT * FROM (SELECT id, file, kind, score, b, row_number() OVER (ORDER BY b DESC, id) AS pos FROM b) WHERE pos <= 12"""


@query(f"WITH {_SCORED}, c AS (SELECT id, file, kind, score FROM scored ORDER BY score DESC, id LIMIT 80), {_DIVERSE}")
def mmr_count_windows(spark: SparkSession, d: str) -> DataFrame:
    return V.diversify(_scored(spark, d).select("id", "file", "kind", "score").orderBy(F.desc("score"), "id").limit(80), 12)


@query(f"""WITH {_SCORED}, top AS (SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 80) WHERE score >= 0.15),
cnt AS (SELECT file, count(*) AS n FROM top GROUP BY file),
more AS (SELECT * FROM (SELECT * FROM scored WHERE file NOT IN (SELECT file FROM cnt WHERE n >= 4) ORDER BY score DESC, id LIMIT 40) WHERE score >= 0.15 AND (SELECT count(*) < 6 AND max(n) >= 4 FROM cnt)),
u AS (SELECT id, file, score FROM top UNION SELECT id, file, score FROM more),
c AS (SELECT id, file, split_part(file, '/', 1) AS kind, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS r FROM u) WHERE r <= 4), {_DIVERSE}""")
def retrieve_diverse(spark: SparkSession, d: str) -> DataFrame:
    found = V.two_pass(_scored(spark, d))
    return V.diversify(found.select("id", "file", F.split_part("file", F.lit("/"), F.lit(1)).alias("kind"), "score"), 12)


@query()
def mmr_vector_greedy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    top = V.knn_join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), 40, True)
    return V.mmr(top.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), "id"), 8)


@query("SELECT count(*) AS vectors, count(DISTINCT label) AS labels, max(len(embedding)) AS dim, count(*) FILTER (WHERE embedding IS NULL) AS missing, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(
        F.count("*").alias("vectors"), F.countDistinct("label").alias("labels"), F.max(F.size("embedding")).cast("bigint").alias("dim"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.round(F.avg(norm(F.col("embedding"))), 6).alias("mean_norm")
    )


@query("SELECT vec_id, len(list_concat(embedding, list_resize([]::FLOAT[], 96 - len(embedding), 0))) AS dim, round(list_sum(list_slice(embedding::DOUBLE[], 1, 48)), 6) AS head_sum FROM embeddings")
def vector_fit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.size(fit(F.col("embedding"), 96)).cast("bigint").alias("dim"), F.round(F.aggregate(fit(F.col("embedding"), 48), F.lit(0.0), lambda a, x: a + x), 6).alias("head_sum"))


@query("""WITH u AS (SELECT label, vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i) GROUP BY label),
s AS (SELECT e.vec_id, e.label, c.label AS cluster, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS score FROM embeddings e, c)
SELECT vec_id, label, cluster, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster) AS r FROM s) WHERE r = 1""")
def centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = V.centroids(e, "label", 64).withColumnRenamed("label", "cluster")
    near = V.knn_join(c.select(F.col("cluster").cast("bigint").alias("id"), F.col("centroid").alias("vec")), e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), 1)
    return near.join(e.select(F.col("vec_id").alias("qid"), "label"), "qid").select(F.col("qid").alias("vec_id"), "label", F.col("id").alias("cluster"), "score")


@query("""WITH v AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS s0,
  round(list_cosine_similarity(list_slice(embedding::DOUBLE[], 1, 32), list_slice((SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[], 1, 32)), 6) AS s1 FROM embeddings),
a AS (SELECT vec_id, row_number() OVER (ORDER BY s0 DESC, vec_id) AS ra FROM v), b AS (SELECT vec_id, row_number() OVER (ORDER BY s1 DESC, vec_id) AS rb FROM v),
j AS (SELECT ra, rb FROM (SELECT * FROM a WHERE ra <= 50) a JOIN (SELECT * FROM b WHERE rb <= 50) b USING (vec_id))
SELECT count(*) AS shared, round(count(*) / (100.0 - count(*)), 6) AS jaccard, round(1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1.0)), 6) AS rank_agreement FROM j""")
def ab_overlap_spearman(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    s = e.join(F.broadcast(_query_vector(spark, d).limit(1))).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("s0"), F.round(cosine(F.slice("embedding", 1, 32), F.slice("q", 1, 32)), 6).alias("s1"))

    def ranked(score: str, name: str) -> DataFrame:
        top = s.orderBy(F.desc(score), "vec_id").limit(50)
        return top.select("vec_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), "vec_id")).alias(name))

    n = F.count("*")
    gap = F.col("ra") - F.col("rb")
    return ranked("s0", "ra").join(ranked("s1", "rb"), "vec_id").agg(n.alias("shared"), F.round(n / (100.0 - n), 6).alias("jaccard"), F.round(1 - 6 * F.sum(gap * gap) / (n * (n * n - 1.0)), 6).alias("rank_agreement"))
