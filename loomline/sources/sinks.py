"""Sinks and table changes on plain Parquet: a change reads a version and writes the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str, day: Column) -> None:
    """JSON lines in one folder per day, so a reader of some days opens no other."""
    df.withColumn("day", F.date_format(day, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def summary(df: DataFrame, group: str, measure: Column) -> DataFrame:
    """One row: count, distinct groups, total, and a map from group to count."""
    per = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("(none)")).alias("g")).agg(F.count("*").alias("n"), F.sum(measure).alias("m"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("groups"), F.coalesce(F.sum("m"), F.lit(0)).alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("g", "n")))).alias("by_group"))


def merge(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key of both tables by ``order``; columns missing on one side become null."""
    both = current.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Without the keys given."""
    return current.join(keys.select(key).distinct(), key, "left_anti")


def delete_like(current: DataFrame, col: str, patterns: list[str]) -> DataFrame:
    """Without rows that match one of the patterns; null stays."""
    return current.filter(~F.coalesce(F.col(col).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def update(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` take over where they are not null; repeated keys: the greatest value."""
    cols = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"_new_{c}") for c in cols])
    return current.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in current.columns])


def with_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns that are missing are added as nulls of their type."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in df.columns])


def upsert_vectors(df: DataFrame, path: str, key: str, buckets: int = 16) -> None:
    """One row per key, in folders by a hash of the key, written as a whole: running it again gives the same table."""
    df.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def verify_count(spark: SparkSession, path: str, expected: int) -> bool:
    return spark.read.parquet(path).count() == expected
