"""Queries on the event log: sessions, states, recommenders, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators import learning as L
from loomline.plans.registry import query
from loomline.session import table

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_E = f"e AS (SELECT event_id, ts, user_id, event_type, value, {_K} AS item, {_K} % 10 AS topic, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.0 END::DOUBLE AS p FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    item = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", item.alias("item"), (item % 10).alias("topic"), F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0).alias("p"))


@query(f"""WITH {_E}, t AS (SELECT user_id, topic, count(*) AS c FROM e GROUP BY 1, 2), m AS (SELECT user_id, topic AS top_topic FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, topic) AS r FROM t) WHERE r = 1)
SELECT e.user_id, count(*) AS total, count(*) FILTER (WHERE p = 1) AS positive, count(*) FILTER (WHERE p = 0) AS negative, round(count(*) FILTER (WHERE p = 1) / greatest(1, count(p))::DOUBLE, 6) AS ratio, any_value(top_topic) AS top_topic, round(sum(value), 2) AS total_value FROM e JOIN m USING (user_id) GROUP BY e.user_id""")
def interaction_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    per = e.groupBy("user_id", "topic").agg(F.count("*").alias("c"), F.count_if(F.col("p") == 1).alias("pos"), F.count_if(F.col("p") == 0).alias("neg"), F.sum("value").alias("s"))
    return per.groupBy("user_id").agg(
        F.sum("c").alias("total"), F.sum("pos").alias("positive"), F.sum("neg").alias("negative"), F.round(F.sum("pos") / F.greatest(F.lit(1), F.sum(F.col("pos") + F.col("neg"))), 6).alias("ratio"),
        F.max_by("topic", F.struct("c", (-F.col("topic")).alias("o"))).alias("top_topic"), F.round(F.sum("s"), 2).alias("total_value"),
    )


_SESS = f"""{_E}, n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 360 MINUTES THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, session_no, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM n) GROUP BY 1, 2)"""


@query(f'WITH {_SESS} SELECT user_id, session_no::BIGINT AS session_no, epoch_us(start) AS start_us, epoch_us("end") AS end_us, events FROM s')
def sessionize_gap(spark: SparkSession, d: str) -> DataFrame:
    s = L.sessions(_events(spark, d))
    return s.select("user_id", "session_no", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "events")


@query(f'WITH {_SESS} SELECT user_id, count(*) AS sessions, round(avg(events), 6) AS mean_events, max(events) AS longest FROM s GROUP BY user_id')
def session_patterns(spark: SparkSession, d: str) -> DataFrame:
    return L.sessions(_events(spark, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.round(F.avg("events"), 6).alias("mean_events"), F.max("events").alias("longest"))


_MASTERY = f"""{_E}, m AS (SELECT user_id, topic, count(*) AS n, round(avg(p), 6) AS rate FROM e WHERE p IS NOT NULL GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN n < 3 THEN 'new' WHEN rate >= 0.7 THEN 'advanced' WHEN rate < 0.3 THEN 'struggling' ELSE 'learning' END AS state FROM m)"""


@query(f"WITH {_MASTERY} SELECT user_id, topic, n, rate, state FROM st")
def topic_mastery(spark: SparkSession, d: str) -> DataFrame:
    return L.mastery(_events(spark, d).filter("p IS NOT NULL"))


@query(f"""WITH {_MASTERY} SELECT user_id, count(*) AS topics, CASE WHEN count(*) FILTER (WHERE state = 'struggling') / count(*)::DOUBLE >= 0.6 THEN 'struggling' WHEN count(*) FILTER (WHERE state = 'advanced') / count(*)::DOUBLE >= 0.6 THEN 'advanced' ELSE 'learning' END AS overall FROM st GROUP BY user_id""")
def overall_state(spark: SparkSession, d: str) -> DataFrame:
    return L.overall_state(L.mastery(_events(spark, d).filter("p IS NOT NULL")))


@query(f"""WITH {_E}, c AS (SELECT user_id, topic, count(*) AS c FROM e GROUP BY 1, 2)
SELECT user_id, count(*) AS topics, max(c) AS most, CASE WHEN count(*) >= 4 AND max(c) <= 1.5 * avg(c) THEN 'explorer' WHEN count(*) <= 2 AND max(c) >= 5 THEN 'deep_diver' ELSE 'balanced' END AS style FROM c GROUP BY user_id""")
def learning_style(spark: SparkSession, d: str) -> DataFrame:
    return L.style(_events(spark, d))


@query(f"WITH {_E} SELECT user_id, count(*) AS events, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS days, round(count(*) / (date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1)::DOUBLE, 6) AS velocity FROM e GROUP BY user_id")
def velocity_daily(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.max("ts"), F.min("ts")) + 1
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), days.alias("days"), F.round(F.count("*") / days, 6).alias("velocity"))


@query(f"WITH {_E}, d AS (SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM e GROUP BY 1, 2) SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM d")
def moving_avg_7(spark: SparkSession, d: str) -> DataFrame:
    daily = _events(spark, d).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return L.moving_mean(daily, "n")


@query(f"WITH {_E} SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r <= 10")
def last_n_interactions(spark: SparkSession, d: str) -> DataFrame:
    return L.last_n(_events(spark, d), 10).select("user_id", "event_id", "r")


@query(f"WITH {_E} SELECT user_id, arg_max(topic, ts) AS topic, arg_max(event_type, ts) AS event_type, epoch_us(max(ts)) AS at_us FROM e GROUP BY user_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.groupBy("user_id").agg(F.max_by("topic", "ts").alias("topic"), F.max_by("event_type", "ts").alias("event_type"), F.unix_micros(F.max("ts").cast("timestamp")).alias("at_us"))


@query(f"WITH {_E} SELECT item, count(*) AS attempts, count(*) FILTER (WHERE p = 1) AS correct, round(count(*) FILTER (WHERE p = 1) / count(*)::DOUBLE, 6) AS rate FROM e WHERE p IS NOT NULL GROUP BY item")
def upsert_accumulate(spark: SparkSession, d: str) -> DataFrame:
    c = F.count_if(F.col("p") == 1)
    return _events(spark, d).filter("p IS NOT NULL").groupBy("item").agg(F.count("*").alias("attempts"), c.alias("correct"), F.round(c / F.count("*"), 6).alias("rate"))


@query(f"""WITH {_E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS after FROM e WHERE p IS NOT NULL)
SELECT user_id, count(*) AS n, round(sum(0.1 * pow(0.9, after) * p) + 0.5 * pow(0.9, count(*)), 6) AS ema FROM k GROUP BY user_id""")
def ema_state_fold(spark: SparkSession, d: str) -> DataFrame:
    return L.ema(_events(spark, d).filter("p IS NOT NULL"))


@query(f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e),
pop AS (SELECT item, row_number() OVER (ORDER BY c DESC, item) AS rank FROM (SELECT item, count(*) AS c FROM r WHERE r > 1 OR n < 2 GROUP BY item) QUALIFY rank <= 10)
SELECT count(*) AS users, round(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(coalesce(1.0 / log2(rank + 1.0), 0.0)), 6) AS ndcg, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS map FROM (SELECT * FROM r WHERE r = 1 AND n >= 2) t LEFT JOIN pop USING (item)""")
def leave_last_out_metrics(spark: SparkSession, d: str) -> DataFrame:
    train, test = L.leave_last_out(_events(spark, d))
    return L.popularity_metrics(train, test)


@query(f"""WITH {_E}, u AS (SELECT DISTINCT user_id, item FROM e), t AS (SELECT DISTINCT user_id, item FROM e WHERE p = 1)
SELECT user_id, count(*) AS negatives FROM (SELECT * FROM u EXCEPT SELECT * FROM t) GROUP BY user_id""")
def negative_pool(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select("user_id", "item").distinct().join(e.filter("p = 1").select("user_id", "item").distinct(), ["user_id", "item"], "left_anti").groupBy("user_id").agg(F.count("*").alias("negatives"))


@query(f"""WITH {_E}, a AS (SELECT item, 1 + count(*) FILTER (WHERE value > 50) AS alpha, 1 + count(*) FILTER (WHERE value <= 50) AS beta FROM e GROUP BY item)
SELECT item, alpha, beta, round(alpha / (alpha + beta)::DOUBLE, 6) AS mean, round(1 / (1 + alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))::DOUBLE), 6) AS confidence FROM a""")
def bandit_arms(spark: SparkSession, d: str) -> DataFrame:
    a = _events(spark, d).groupBy("item").agg((1 + F.count_if(F.col("value") > 50)).alias("alpha"), (1 + F.count_if(F.col("value") <= 50)).alias("beta"))
    x, y = F.col("alpha"), F.col("beta")
    return a.select("item", "alpha", "beta", F.round(x / (x + y), 6).alias("mean"), F.round(1 / (1 + x * y / ((x + y) * (x + y) * (x + y + 1))), 6).alias("confidence"))


@query(f"""WITH {_E}, t AS (SELECT event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean FROM e GROUP BY 1)
SELECT event_type, n, round(total, 4) AS total, round(mean, 6) AS mean, round(100.0 * total / (SELECT sum(value) FROM e), 4) AS share_pct FROM t""")
def stage_shares(spark: SparkSession, d: str) -> DataFrame:
    g = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("m"))
    every = F.sum("s").over(Window.partitionBy(F.lit(1)))
    return g.select("event_type", "n", F.round("s", 4).alias("total"), F.round("m", 6).alias("mean"), F.round(100.0 * F.col("s") / every, 4).alias("share_pct"))


@query(f"WITH {_E}, q AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q, min(value) AS least, max(value) AS greatest FROM e GROUP BY 1) SELECT event_type, round(q[1], 6) AS q25, round(q[2], 6) AS median, round(q[3], 6) AS q75, least, greatest FROM q")
def value_profile(spark: SparkSession, d: str) -> DataFrame:
    q = _events(spark, d).groupBy("event_type").agg(F.percentile("value", [0.25, 0.5, 0.75]).alias("q"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return q.select("event_type", F.round(F.col("q")[0], 6).alias("q25"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q75"), "least", "greatest")


@query("""WITH done AS (SELECT DISTINCT doc_id FROM chunk_metadata) SELECT source, count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM done) GROUP BY source""")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "chunk_metadata").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("pending"))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), cached AS (SELECT DISTINCT h FROM h WHERE doc_id % 3 = 0) SELECT count(*) AS misses, count(DISTINCT h) AS distinct_misses FROM h WHERE h NOT IN (SELECT h FROM cached)""")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return h.join(h.filter("doc_id % 3 = 0").select("h").distinct(), "h", "left_anti").agg(F.count("*").alias("misses"), F.countDistinct("h").alias("distinct_misses"))


@query("""SELECT p_partkey, p_brand, p_size, rank FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN own = 1 THEN 0 ELSE 1 END, dist, p_partkey) AS rank FROM
(SELECT p_partkey, p_brand, p_size, abs(p_size - 25) AS dist, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), p_partkey) AS own FROM part)) WHERE rank <= 40""")
def item_select_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Nearest to an anchor, a first pass with one of each brand, then the rest: each brand gives 40 rows at most to the last sort."""
    w = Window.partitionBy("p_brand").orderBy("dist", "p_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.abs(F.col("p_size") - 25).alias("dist")).withColumn("own", F.row_number().over(w)).filter("own <= 40")
    last = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col("own") == 1, 0).otherwise(1), "dist", "p_partkey")
    return p.withColumn("rank", F.row_number().over(last)).filter("rank <= 40").select("p_partkey", "p_brand", "p_size", "rank")


@query()
def elo_ability(spark: SparkSession, d: str) -> DataFrame:
    """Ability per user and topic against item difficulties from the log, as keyed folds."""
    from loomline.streaming.state import elo_batch

    return elo_batch(_events(spark, d).filter("p IS NOT NULL"))


@query()
def als_recommend(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.models import als_top

    e = _events(spark, d)
    return als_top(e.groupBy(F.col("user_id").cast("int").alias("user"), "item").agg(F.sum("value").cast("float").alias("rating")), 5)


@query()
def tfidf_topics(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.models import tfidf_kmeans

    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    return tfidf_kmeans(docs, 8)


@query()
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Report of the topic model: size, label, best terms and examples of each cluster."""
    from loomline.operators.models import topic_report, topics

    return topic_report(*topics(table(spark, d, "documents")))


def _stop_words() -> str:
    from loomline.operators.models import STOP

    return ", ".join(f"'{w}'" for w in STOP)


@query(rf"""WITH t AS (SELECT list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda x: length(x) >= 3 AND x NOT IN ({_stop_words()})) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM t)
SELECT term, count(*) AS df FROM (SELECT unnest(g) AS term FROM g) GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.6 * (SELECT count(*) FROM t)""")
def topic_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.models import vocabulary

    return vocabulary(table(spark, d, "documents"))


@query("""WITH r AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 13 - 1 AS feedback FROM events), t AS (SELECT user_id, CASE WHEN feedback BETWEEN 1 AND 10 THEN (feedback - 1) / 9.0 WHEN feedback = -1 THEN 0.0 END::DOUBLE AS target FROM r)
SELECT user_id, count(*) AS rows, count(target) AS rated, round(avg(target), 6) AS mean_target FROM t GROUP BY 1""")
def rating_targets(spark: SparkSession, d: str) -> DataFrame:
    feedback = F.floor("value").cast("bigint") % 13 - 1
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("rows"), F.count(L.rating_target(feedback)).alias("rated"), F.round(F.avg(L.rating_target(feedback)), 6).alias("mean_target"))


@query(f"""WITH {_E}, day AS (SELECT user_id, topic, date_trunc('day', ts) AS d, sum(p) AS hits, count(p) AS n FROM e WHERE p IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, topic, epoch_us(d) AS day_us, CAST(sum(n) OVER w AS BIGINT) AS seen, round(sum(hits) OVER w / sum(n) OVER w, 6) AS ability FROM day WINDOW w AS (PARTITION BY user_id, topic ORDER BY d)""")
def ability_history(spark: SparkSession, d: str) -> DataFrame:
    """Ability of each user and topic after each day; events are added up by day first, so that a window holds days and not events."""
    day = _events(spark, d).filter("p IS NOT NULL").groupBy("user_id", "topic", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("at")).agg(F.sum("p").alias("hits"), F.count("p").alias("n"))
    w = Window.partitionBy("user_id", "topic").orderBy("at")
    return day.select("user_id", "topic", F.unix_micros("at").alias("day_us"), F.sum("n").over(w).alias("seen"), F.round(F.sum("hits").over(w) / F.sum("n").over(w), 6).alias("ability"))
