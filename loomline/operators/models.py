"""Models of pyspark.ml: factorisation and topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.recommendation import ALS
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from loomline.functions.text import once
from loomline.session import written

# English function words that make no topic; a parameter of the operators.
STOP = "the and that for with from this these those than then not are was were but which when what who how why does did can has have had been being they them their there here you your our his her its about into over under between after before during through while once only most often may should would could will more less every any some such because without until since near too very also".split()


def als_top(ratings: DataFrame, k: int, rank: int = 16, seed: int = 42) -> DataFrame:
    """(user, item, score, pos): k items for each user by alternating least squares over (user, item, rating)."""
    model = ALS(userCol="user", itemCol="item", ratingCol="rating", rank=rank, maxIter=5, regParam=0.1, implicitPrefs=True, seed=seed).fit(ratings)
    return model.recommendForAllUsers(k).select("user", F.posexplode("recommendations").alias("pos", "r")).select("user", F.col("r.item").alias("item"), F.round("r.rating", 4).alias("score"), "pos")


def tfidf_kmeans(docs: DataFrame, k: int, features: int = 1 << 12, seed: int = 7) -> DataFrame:
    """(doc_id, cluster) by k-means over normalised TF-IDF of (doc_id, text). Hashed terms need no vocabulary on the driver."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}]+", minTokenLength=3),
        StopWordsRemover(inputCol="words", outputCol="kept"),
        HashingTF(inputCol="kept", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="idf", minDocFreq=2),
        Normalizer(inputCol="idf", outputCol="features"),
    ]
    vectors = Pipeline(stages=stages).fit(docs).transform(docs).select("doc_id", "features").persist()
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="features", predictionCol="cluster").fit(vectors)
    out = model.transform(vectors).select("doc_id", "cluster")
    return out


def terms_of(text: Column, stop: list[str] | None = None) -> Column:
    """Words of three letters or more without stop words, and pairs of neighbours among them."""
    kept = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*(stop or STOP)))
    return once(kept, lambda k: F.concat(k, F.transform(F.slice(k, 2, F.size(k)), lambda w, i: F.concat_ws(" ", F.get(k, i), w))))


def vocabulary(docs: DataFrame, least: int = 2, most: float = 0.6) -> DataFrame:
    """(term, df): words and pairs in at least ``least`` documents and at most the share ``most`` of them."""
    rows = docs.filter("text IS NOT NULL")
    counted = rows.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.join(F.broadcast(rows.agg(F.count("*").alias("n"))), (F.col("df") >= least) & (F.col("df") <= F.col("n") * most)).select("term", "df")


def _flagged(terms: Column) -> Column:
    """(term, first) of each term in order; ``first`` is 1 at one of equal terms."""
    return once(F.array_sort(terms), lambda s: F.transform(s, lambda t, i: F.struct(t.alias("term"), F.when(F.get(s, i - 1) == t, 0).otherwise(1).alias("first"))))


def _project(components: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [np.asarray(v) @ components[np.asarray(i, dtype=np.int64)] for i, v in zip(pdf["at"], pdf["weight"], strict=True)]
            yield pdf.assign(x=rows)

    return run


def _components(weights: DataFrame, count: int) -> np.ndarray:
    """The first right singular vectors of the rows of ``features``. Every step of the solver reads all rows again, so they are kept in memory for it."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(weights.select("features"), "features"))
    rows = matrix._java_matrix_wrapper._java_model.rows()
    rows.persist(weights.sparkSession.sparkContext._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK_DESER))
    try:
        return matrix.computeSVD(count).V.toArray()
    finally:
        rows.unpersist(False)


def topics(docs: DataFrame, ks: tuple[int, ...] = (4, 8, 12), size: int = 20_000, components: int = 30, least: int = 2, most: float = 0.6, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Topic model of (doc_id, text): (doc_id, cluster) and (term, cluster, weight), the mean TF-IDF weight of the terms of each cluster.

    TF-IDF over words and pairs of a vocabulary of at most ``size`` terms, the most frequent and of equal ones the first by name,
    truncated SVD to ``components`` dimensions by a distributed ``RowMatrix``, k-means for each of ``ks``; the k with the best
    silhouette holds, of equal ones the least. Only the vocabulary and the ``size`` x ``components`` matrix reach the driver, both
    bounded by parameters. Documents without any term are in no cluster.
    """
    spark = docs.sparkSession
    given = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = given.select("doc_id", terms_of(F.col("text")).alias("terms"))
    total = given.count()
    counted = rows.select(F.inline(_flagged(F.col("terms")))).groupBy("term").agg(F.count("*").alias("n"), F.sum("first").alias("df"))
    known = counted.filter((F.col("df") >= least) & (F.col("df") <= total * most)).orderBy(F.desc("n"), "term").limit(size).collect()
    if not known:
        return given.select("doc_id", F.lit(0).alias("cluster")).limit(0), given.select(F.lit("").alias("term"), F.lit(0).alias("cluster"), F.lit(0.0).alias("weight")).limit(0)
    words, width = [r.term for r in known], len(known)
    idf = np.log((total + 1) / (np.array([r.df for r in known]) + 1))
    counts = CountVectorizerModel.from_vocabulary(words, "terms", "tf").transform(rows)
    weighed = Normalizer(inputCol="idf", outputCol="features").transform(ElementwiseProduct(scalingVec=DenseVector(idf), inputCol="tf", outputCol="idf").transform(counts))
    vectors = written(weighed.select("doc_id", "features"), "weights")
    sparse = spark.read.schema("doc_id bigint, features struct<indices: array<int>, values: array<double>>").parquet(*vectors.inputFiles())
    weights = sparse.select("doc_id", F.col("features.indices").alias("at"), F.col("features.values").alias("weight")).filter(F.size("at") > 0)
    low = _components(vectors, min(components, width, weights.count()))
    projected = weights.mapInPandas(_project(low), "doc_id bigint, at array<int>, weight array<double>, x array<double>").withColumn("features", array_to_vector("x"))
    points = written(projected.select("doc_id", "features"), "points").persist()
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    best = None
    for k in ks:
        fitted = KMeans(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="cluster").fit(points)
        placed = fitted.transform(points)
        score = judge.evaluate(placed) if placed.select("cluster").distinct().count() > 1 else -1.0
        if best is None or score > best[0]:
            best = (score, fitted)
    clusters = written(best[1].transform(points).select("doc_id", "cluster"), "clusters")
    points.unpersist()
    names = spark.createDataFrame(pd.DataFrame({"i": np.arange(width, dtype=np.int32), "term": words}))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = best[1].transform(projected).select("cluster", F.explode(F.arrays_zip("at", "weight")).alias("p")).groupBy("cluster", F.col("p.at").alias("i")).agg(F.sum("p.weight").alias("w"))
    return clusters, sums.join(sizes, "cluster").join(names, "i").select("term", "cluster", (F.col("w") / F.col("n")).alias("weight"))


def topic_report(clusters: DataFrame, terms: DataFrame, top: int = 12, examples: int = 5) -> DataFrame:
    """(cluster, documents, share, label, top_terms, examples): size, best terms, a label of three of them and a few documents of each cluster."""
    by_weight = Window.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    best = terms.withColumn("r", F.row_number().over(by_weight)).filter(F.col("r") <= top).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("t"))
    by_id = Window.partitionBy("cluster").orderBy("doc_id")
    first = clusters.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= examples).groupBy("cluster").agg(F.array_sort(F.collect_list("doc_id")).alias("examples"))
    total = clusters.agg(F.count("*").alias("all"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("documents")).join(F.broadcast(total)).withColumn("share", F.round(F.col("documents") / F.col("all"), 6))
    names = F.col("t.term")
    return sizes.join(best, "cluster", "left").join(first, "cluster").select("cluster", "documents", "share", F.array_join(F.slice(names, 1, 3), ", ").alias("label"), F.array_join(names, ", ").alias("top_terms"), F.array_join("examples", ", ").alias("examples"))
