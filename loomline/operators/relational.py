"""Joins on time that Spark has no operator for, as compositions of windows and equi-joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], slicer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time; nulls if there is none.

    Both sides go into one sorted stream per key and slice of time, and the last right row is carried forward: no pair of
    rows is ever made. ``slicer`` cuts a key's time into slices (such as days), so that a hot key is spread over tasks;
    what a slice inherits comes from one row per slice before it. Null keys or times match nothing.
    """
    cut = slicer or (lambda t: F.lit(0))
    payload = F.struct(*[F.col(v) for v in values])
    kind = right.select(payload.alias("x")).schema["x"].dataType
    a = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(kind).alias("_r"))
    b = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    both = a.unionByName(b).withColumn("_s", cut(F.col("_t")))
    w = Window.partitionBy("_k", "_s").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if slicer:
        ends = both.groupBy("_k", "_s").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
        before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        inherited = ends.select("_k", "_s", F.last("_end", ignorenulls=True).over(before).alias("_old")).filter("_old IS NOT NULL")
        carried = carried.join(inherited, ["_k", "_s"], "left").withColumn("_last", F.coalesce("_last", "_old"))
    return carried.select("_l.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_last.{v}")).alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, reach: int) -> DataFrame:
    """Pairs of one key whose positions (integers) differ by at most ``reach``: the right side is sorted into bins of that
    width, each left row looks into three bins, and the rest is an equi-join that AQE can split where it is skewed."""
    binned = right.withColumn("_bin", F.floor(F.col(right_at) / reach))
    looking = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(left_at) / reach) + i for i in (-1, 0, 1)])))
    return looking.join(binned, [key, "_bin"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_bin")
