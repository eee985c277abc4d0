"""Exact vector search, capped retrieval and diversity."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.vectors import cosine


def predicate(conditions: dict[str, Any]) -> Column:
    """Metadata conditions ``{field: value}`` or ``{field: {"$eq"|"$ne"|"$in"|"$nin"|"$gte"|"$lte": value}}`` as one column; Catalyst pushes it to the scan."""
    out = F.lit(True)
    for field, cond in conditions.items():
        for op, value in (cond if isinstance(cond, dict) else {"$eq": cond}).items():
            c = F.col(field)
            try:
                out = out & {
                    "$eq": lambda c=c, v=value: c == v,
                    "$ne": lambda c=c, v=value: c != v,
                    "$in": lambda c=c, v=value: c.isin(list(v)),
                    "$nin": lambda c=c, v=value: ~c.isin(list(v)),
                    "$gte": lambda c=c, v=value: c >= v,
                    "$lte": lambda c=c, v=value: c <= v,
                }[op]()
            except KeyError:
                raise ValueError(f"unknown operator {op}") from None
    return out


def search(vectors: DataFrame, query_vector: DataFrame, k: int, least: float | None = None, where: dict[str, Any] | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Top-k rows by cosine to one query vector (a one-row table (q)). Null vectors are left out; ties go to the lower id."""
    kept = vectors.filter(predicate(where)) if where else vectors
    scored = kept.join(F.broadcast(query_vector.limit(1))).withColumn("score", F.round(cosine(F.col(vec_col), F.col("q")), 6)).drop("q", vec_col).filter("score IS NOT NULL")
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def knn_join(corpus: DataFrame, queries: DataFrame, k: int, exclude_same: bool = False, query_block: int = 4096, corpus_block: int = 50_000, by_label: bool = False) -> DataFrame:
    """(qid, id, score, rank): the k nearest of corpus (id, vec) to each of queries (qid, vec), exact.

    ``by_label``: both sides have a ``label``, and the result a column ``same``; the k nearest of the same and the k
    nearest of another label are kept for each query. A null label on either side makes neither.

    Both sides are cut into blocks of bounded size; each pair of blocks is one task of a block nested-loop
    product that keeps k candidates per query, and a window ranks the survivors. No pair of rows is emitted.
    """
    q = queries.filter("qid IS NOT NULL AND vec IS NOT NULL")
    c = corpus.filter("id IS NOT NULL AND vec IS NOT NULL")
    q_blocks = max(1, -(-q.count() // query_block))
    c_blocks = max(q.sparkSession.sparkContext.defaultParallelism, -(-c.count() // corpus_block))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(q_blocks))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = c.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint"))))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), **({"same": pd.Series(dtype="bool")} if by_label else {})})
        right = right.sort_values("id")
        ids, all_qids, across = right["id"].to_numpy(), left["qid"].to_numpy(), _unit(right["vec"]).T
        rows = max(1, 4_000_000 // len(ids))  # of queries at once: 32 MB of scores
        out = []
        for at in range(0, len(left), rows):
            part = left.iloc[at : at + rows]
            qids = all_qids[at : at + rows]
            s = _unit(part["vec"]) @ across
            np.round(s, 6, out=s)
            if exclude_same:
                s[qids[:, None] == ids[None, :]] = -np.inf
            if not by_label:
                out.append(nearest(s, ids, qids))
                continue
            a, b = part["label"].to_numpy()[:, None], right["label"].to_numpy()[None, :]
            known = part["label"].notna().to_numpy()[:, None] & right["label"].notna().to_numpy()[None, :]
            out += [nearest(np.where(known & ((a == b) == same), s, -np.inf), ids, qids).assign(same=same) for same in (True, False)]
        return pd.concat(out)

    def nearest(s: np.ndarray, ids: np.ndarray, qids: np.ndarray) -> pd.DataFrame:
        """The k best of each row by a partial sort; ties at the k-th score go to the lower id, in the order of the columns."""
        least = np.partition(s, -k, axis=1)[:, -k] if k < s.shape[1] else np.full(len(s), -np.inf)
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        order = np.lexsort((j, -s[i, j], i))
        i, j = i[order], j[order]
        first = np.searchsorted(i, np.arange(len(s)))
        kept = np.arange(len(i)) - first[i] < k
        i, j = i[kept], j[kept]
        return pd.DataFrame({"qid": qids[i], "id": ids[j], "score": s[i, j]})

    best = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(block, "qid bigint, id bigint, score double" + (", same boolean" if by_label else ""))
    order = Window.partitionBy("qid", *(["same"] if by_label else [])).orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def two_pass(scored: DataFrame, first: int = 80, second: int = 40, per_file: int = 4, least: float = 0.15, want_files: int = 6) -> DataFrame:
    """Capped retrieval over scored rows (id, file, score): the first pass takes the best ``first``, at most ``per_file``
    of a file; if fewer than ``want_files`` files came and one is full, a second pass without the full files adds more."""
    ranked = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    top = scored.orderBy(F.desc("score"), "id").limit(first).filter(F.col("score") >= least)
    full = top.groupBy("file").agg(F.count("*").alias("n"))
    dominant = full.filter(F.col("n") >= per_file).select("file")
    go = full.agg(((F.count("*") < want_files) & (F.max("n") >= per_file)).alias("go"))
    more = scored.join(F.broadcast(dominant), "file", "left_anti").orderBy(F.desc("score"), "id").limit(second).filter(F.col("score") >= least)
    more = more.join(F.broadcast(go)).filter("go").drop("go")
    both = top.select("id", "file", "score").unionByName(more.select("id", "file", "score")).distinct()
    return both.withColumn("file_rank", F.row_number().over(ranked)).filter(F.col("file_rank") <= per_file)


def diversify(candidates: DataFrame, k: int, by: tuple[str, ...] = (), per_file: int = 2, file_penalty: float = 0.3, type_penalty: float = 0.05) -> DataFrame:
    """Greedy selection by counts, as windows: file penalties nest in type penalties, so ranking within the file, then
    within the type, gives what the greedy loop gives. Candidates (id, file, kind, score[, by])."""
    of_file = Window.partitionBy(*by, "file").orderBy(F.desc("score"), "id")
    of_kind = Window.partitionBy(*by, "kind").orderBy(F.desc("a"), "id")
    last = Window.partitionBy(*(by or (F.lit(1),))).orderBy(F.desc("b"), "id")
    return (
        candidates.withColumn("rf", F.row_number().over(of_file)).filter(F.col("rf") <= per_file)
        .withColumn("a", F.round(F.col("score") - file_penalty * (F.col("rf") - 1), 6))
        .withColumn("rt", F.row_number().over(of_kind))
        .withColumn("b", F.round(F.col("a") - type_penalty * (F.col("rt") - 1), 6))
        .withColumn("pos", F.row_number().over(last)).filter(F.col("pos") <= k).drop("rf", "rt", "a")
    )


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Classic maximal marginal relevance per query over its candidates (qid, id, score, vec); the caller bounds the
    candidates per query by a top-k, so a group is small. Ties go to the lower id."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        v, rel = _unit(pdf["vec"]), pdf["score"].to_numpy()
        sims, chosen, near = v @ v.T, [], np.full(len(pdf), -np.inf)
        left = np.ones(len(pdf), dtype=bool)
        for _ in range(min(k, len(pdf))):
            value = weight * rel - (1 - weight) * np.where(np.isfinite(near), near, 0.0)
            i = int(np.flatnonzero(left)[np.argmax(np.round(value[left], 9))])
            chosen.append((i, value[i]))
            left[i] = False
            near = np.maximum(near, sims[i])
        idx = [i for i, _ in chosen]
        return pd.DataFrame({"qid": pdf["qid"].iloc[idx].to_numpy(), "id": pdf["id"].iloc[idx].to_numpy(), "pos": range(1, len(idx) + 1), "value": [round(float(x), 6) for _, x in chosen]})

    return candidates.groupBy("qid").applyInPandas(pick, "qid bigint, id bigint, pos int, value double")


def centroids(vectors: DataFrame, group: str, dim: int, vec_col: str = "embedding") -> DataFrame:
    """Mean vector of each group by ``dim`` partial averages; nothing is collected."""
    means = [F.avg(F.get(F.col(vec_col), i).cast("double")).alias(f"m{i}") for i in range(dim)]
    return vectors.groupBy(group).agg(*means).select(group, F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("centroid"))
