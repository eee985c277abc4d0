"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v), u > v. The minimum of each neighbourhood comes from an aggregate
    with map-side combine and is joined back, so no neighbourhood is ever held as a list."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    rest = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each end of the links (a, b); a component is named by its least node.

    Self links and nulls are ignored. The rounds grow with the logarithm of the longest chain; each is
    checkpointed in the shared folder. An empty link table gives no rows.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    before = None
    for _ in range(max_rounds):
        edges = cut_lineage(_star(_star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
