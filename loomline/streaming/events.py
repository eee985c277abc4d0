"""Structured Streaming twins of the event queries. Each runs to the end of its input, keeps offsets and state in the
shared folder, and hands back what it wrote, so a lost executor or a restart goes on from the last batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import ensure_checkpoint_dir, exists, table
from loomline.streaming.state import ema_update


def source(spark: SparkSession, sf_dir: str, name: str = "events", files_per_batch: int = 8) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _place(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def closable(events: DataFrame) -> tuple[DataFrame, str]:
    """The stream and beside it the rows of a folder, empty at first. A row far in the future written there (``close``) moves the watermark past
    all windows, so that ``append`` hands out those still open at the end of the input."""
    spark, place = events.sparkSession, _place(events.sparkSession)
    spark.createDataFrame([], events.schema).write.parquet(f"{place}/closing")
    return events.unionByName(spark.readStream.schema(events.schema).parquet(f"{place}/closing")), place


def close(spark: SparkSession, place: str, row: DataFrame) -> None:
    row.write.mode("append").parquet(f"{place}/closing")


def run_to_end(stream: DataFrame, mode: str, place: str | None = None) -> DataFrame:
    """Run with ``availableNow``; each batch goes to its own folder, so a repeated batch replaces itself, and the result is what all
    batches wrote. With the ``place`` of an earlier run, that run goes on. In ``append`` mode a window comes out once the watermark has passed its
    end, and its state is dropped; in ``update`` mode each batch hands out what it changed."""
    spark, place = stream.sparkSession, place or _place(stream.sparkSession)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")
        last.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if not last and not exists(spark, f"{place}/out"):
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0)).select("batch", *stream.columns)
    out = spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out")
    return out.select("batch", *stream.columns)


def daily_counts(events: DataFrame) -> DataFrame:
    """Tumbling windows of a day per kind of event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    return timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def gap_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Session windows per user."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def running_ema(events: DataFrame) -> DataFrame:
    """One running mean per user in the state store, updated with each batch."""
    return events.groupBy("user_id").applyInPandasWithState(ema_update, "user_id bigint, n bigint, ema double", "value double, n bigint", "update", "NoTimeout")


def latest(updates: DataFrame, key: str | tuple[str, ...], order: str) -> DataFrame:
    """The last update of each key."""
    keys = (key,) if isinstance(key, str) else key
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


Twin = Callable[[DataFrame], DataFrame]


def item_counts(events: DataFrame) -> DataFrame:
    """Attempts and successes per item, kept up to date."""
    return events.groupBy("item").agg(F.count("*").alias("attempts"), F.sum("p").alias("correct"))
