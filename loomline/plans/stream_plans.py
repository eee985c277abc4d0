"""Streaming queries, checked against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.event_plans import _E
from loomline.plans.registry import query
from loomline.session import table
from loomline.streaming import events as S


@query("SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """In ``update`` mode the watermark drops the state of days that are over; the last update of a day and kind holds."""
    out = S.latest(S.run_to_end(S.daily_counts(S.source(spark, d)), "update"), ("day", "event_type"), "n")
    return out.select(F.unix_micros("day").alias("day_us"), "event_type", "n", "total")


@query(f"""WITH {_E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM e WHERE p IS NOT NULL)
SELECT user_id, count(*) AS n, round(sum(0.1 * pow(0.9, after) * p) + 0.5 * pow(0.9, count(*)), 6) AS ema FROM k GROUP BY user_id""")
def stream_ema(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0)
    events = S.source(spark, d).withColumn("p", p).filter("p IS NOT NULL").select("user_id", "ts", "event_id", "p")
    return S.latest(S.run_to_end(S.running_ema(events), "update"), "user_id", "n")


@query(f"""WITH {_E}, n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM n) GROUP BY user_id, k) SELECT * FROM s""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """In ``append`` mode a session comes out once, when the watermark has passed its gap; a second run closes those still open."""
    events, place = S.closable(S.source(spark, d))
    S.run_to_end(S.gap_sessions(events), "append", place)
    far = table(spark, d, "events").agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    schema = events.schema
    S.close(spark, place, far.filter("ts IS NOT NULL").select(*[F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))
    out = S.run_to_end(S.gap_sessions(events), "append", place)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query(f"WITH {_E} SELECT item, count(*) AS attempts, sum(p) AS correct FROM e WHERE p IS NOT NULL GROUP BY item")
def stream_item_counts(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0)
    events = S.source(spark, d).withColumn("p", p).filter("p IS NOT NULL").withColumn("item", F.get_json_object("props", "$.k").cast("int"))
    return S.latest(S.run_to_end(S.item_counts(events), "update"), "item", "attempts")
