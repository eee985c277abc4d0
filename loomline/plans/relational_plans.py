"""Relational queries: joins of all kinds, rollup and cube, windows, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.relational import as_of_join, range_join
from loomline.plans.registry import query
from loomline.session import table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    per = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # aggregated before the joins
    j = per.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("""SELECT coalesce(r_name, 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)""")
def balance_cube(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.cube("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "customers", "balance")


@query("""SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_orders_per_customer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).filter("r <= 3")


@query("""SELECT c_mktsegment, count(*) AS customers, count(o_custkey) AS with_orders FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey GROUP BY 1""")
def customers_with_orders(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_custkey").distinct()
    return _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("o_custkey").alias("with_orders"))


@query("""WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT coalesce(s.k, c.k) AS nation, suppliers, customers FROM s FULL OUTER JOIN c ON s.k = c.k""")
def full_outer_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = _t(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full_outer")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, user_id, ts AS view_ts FROM events WHERE event_type = 'view')
SELECT e.event_id, v.view_id FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.view_ts""")
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return as_of_join(left, right, "user_id", "ts", "view_ts", ["view_id"], F.to_date).select("event_id", "view_id")


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error')
SELECT p.event_id, count(*) AS errors_near FROM p JOIN q ON p.user_id = q.user_id AND q.us BETWEEN p.us - 43200000000 AND p.us + 43200000000 GROUP BY 1""")
def range_join_errors(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", us.alias("us"))
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    q = e.filter("event_type = 'error'").select("user_id", F.col("us").alias("at"))
    return range_join(p, q, "user_id", "us", "at", 43_200_000_000).groupBy("event_id").agg(F.count("*").alias("errors_near"))
