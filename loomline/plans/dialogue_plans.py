"""Queries on the question log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import dialogue as D
from loomline.plans.corpus_plans import _q, _sq
from loomline.plans.registry import query
from loomline.session import table

_NORM = _sq(r"regexp_replace(lower(coalesce(question, '')), '[^\p{L}\p{N}\s\p{Z}]+', ' ', 'g')")
_AT = "try_cast(replace(trim(ts), 'T', ' ') AS TIMESTAMPTZ)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Each logged row once, with its time."""
    rows = table(spark, d, "conversations").select("id", "ts", "ip_hash", "question", "answer", "confidence", "latency_s").distinct()
    return rows.withColumn("at", D.event_time(F.col("ts")))


_LOG = f"log AS (SELECT DISTINCT id, ts, ip_hash, question, answer, confidence, latency_s, {_AT} AS seen FROM conversations)"


@query("SELECT coalesce(upper(trim(confidence)), '(none)') AS confidence, count(*) AS rows, count(DISTINCT id) AS ids, round(avg(latency_s), 6) AS mean_latency, round(max(latency_s), 6) AS max_latency FROM conversations GROUP BY 1")
def conv_log_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("confidence", F.coalesce(F.upper(F.trim("confidence")), F.lit("(none)")))
    return c.groupBy("confidence").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.round(F.avg("latency_s"), 6).alias("mean_latency"), F.round(F.max("latency_s"), 6).alias("max_latency"))


@query("SELECT DISTINCT ip_hash, CASE WHEN coalesce(ip_hash, '') = '' THEN '' ELSE substr(sha256('salt' || ip_hash), 1, 16) END AS hashed FROM conversations")
def hash_pii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("ip_hash").distinct().select("ip_hash", D.salted_hash(F.col("ip_hash"), "salt").alias("hashed"))


_TALK = " ".join(f"WHEN n IN ({', '.join(map(_q, p))}) THEN '{k}'" for k, p in D.SMALL_TALK.items())
_DETAIL = "(" + " OR ".join(f"contains(n, {_q(x)})" for x in D.DETAIL) + ")"


@query(f"""WITH {_LOG}, s AS (SELECT *, {_NORM} AS n FROM log),
g AS (SELECT CASE WHEN n = '' THEN 'greeting' {_TALK} END AS talk, CASE WHEN n = '' THEN 8 WHEN len(string_split(n, ' ')) <= 3 OR len(string_split(n, ' and ')) - 1 >= 2 OR {_DETAIL} THEN 12 ELSE 8 END AS width FROM s)
SELECT coalesce(talk, 'question') AS gate, width, count(*) AS rows FROM g GROUP BY 1, 2""")
def gate_cascade(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return _log(spark, d).select(F.coalesce(D.small_talk(q), F.lit("question")).alias("gate"), D.width(q).alias("width")).groupBy("gate", "width").agg(F.count("*").alias("rows"))


@query(f"""WITH {_LOG}, t AS (SELECT id, rtrim(regexp_replace(lower(coalesce(question, '')), '^\\s+|\\s+$', '', 'g'), '!?.') AS q FROM log),
w AS (SELECT q, regexp_replace(q, '[^a-z]', '', 'g') AS l, string_split_regex(q, '\\s+') AS ws FROM t)
SELECT len(list_filter(range(1, length(q) - 2), lambda i: substr(q, i, 4) = repeat(substr(q, i, 1), 4) AND substr(q, i, 1) <> chr(10))) > 0
OR (length(l) >= 4 AND NOT regexp_matches(l, '[aeiou]'))
OR len(list_filter(ws, lambda x: regexp_matches(regexp_replace(x, '[^a-z]', '', 'g'), '[bcdfghjklmnpqrstvwxz]{{5,}}'))) > 0
OR len(list_filter(ws, lambda x: regexp_full_match(x, '\\p{{L}}+') AND NOT (length(x) >= 4 AND NOT regexp_matches(x, '[aeiou]')))) = 0 AS gibberish, count(*) AS rows FROM w GROUP BY 1""")
def gibberish_filter(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("id", D.gibberish(F.col("question")).alias("gibberish")).groupBy("gibberish").agg(F.count("*").alias("rows"))


@query(f"""WITH {_LOG},
r AS (SELECT *, row_number() OVER (PARTITION BY ip_hash ORDER BY seen, id) AS rn FROM log WHERE seen IS NOT NULL)
SELECT a.id, coalesce(string_agg(substr(b.question, 1, 200), ' / ' ORDER BY b.rn), '') AS history FROM r a LEFT JOIN r b ON a.ip_hash = b.ip_hash AND b.rn BETWEEN a.rn - 4 AND a.rn - 1 GROUP BY a.id, a.rn, a.ip_hash""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return D.history(_log(spark, d).filter("at IS NOT NULL"))


_VAGUE = "(" + " OR ".join(f"contains(lower(' ' || question || ' '), {_q(x)})" for x in D.VAGUE) + ")"


@query(f"""WITH {_LOG}, r AS (SELECT id, question, lag(question) OVER (PARTITION BY coalesce(ip_hash, 'row ' || id) ORDER BY seen, id) AS before FROM log WHERE seen IS NOT NULL)
SELECT id, md5(CASE WHEN {_VAGUE} AND before IS NOT NULL THEN before || ' — ' || question ELSE question END) AS resolved_md5, {_VAGUE} AND before IS NOT NULL AS vague FROM r""")
def pronoun_resolution(spark: SparkSession, d: str) -> DataFrame:
    return D.resolve(_log(spark, d).filter("at IS NOT NULL")).select("id", F.md5("resolved").alias("resolved_md5"), "vague")


@query(f"""WITH {_LOG} SELECT CAST(seen AT TIME ZONE 'UTC' AS DATE)::VARCHAR AS day, count(*) AS rows, count(DISTINCT ip_hash) AS askers, max(c) AS busiest FROM
(SELECT *, count(*) OVER (PARTITION BY ip_hash, CAST(seen AT TIME ZONE 'UTC' AS DATE)) AS c FROM log WHERE seen IS NOT NULL) GROUP BY 1""")
def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    per = _log(spark, d).filter("at IS NOT NULL").groupBy(F.to_date("at").cast("string").alias("day"), "ip_hash").agg(F.count("*").alias("c"))
    return per.groupBy("day").agg(F.sum("c").alias("rows"), F.count("ip_hash").alias("askers"), F.max("c").alias("busiest"))


@query("""SELECT DISTINCT id, CASE WHEN json_valid(sources) THEN json_array_length(sources) END AS n_parsed, CASE WHEN json_valid(sources) THEN replace(json_extract_string(sources, '$[0]'), '\\', '/') END AS first_source FROM conversations""".replace("\\\\", "\\"))
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("sources", "array<string>")
    return table(spark, d, "conversations").select("id", F.size(parsed).alias("n"), T.clean_path(F.get(parsed, F.lit(0))).alias("first_source")).select("id", F.when(F.col("n") >= 0, F.col("n")).alias("n_parsed"), "first_source").distinct()


@query("""WITH s AS (SELECT DISTINCT id, replace(unnest(from_json(sources, '["VARCHAR"]')), '\\', '/') AS path FROM conversations WHERE json_valid(sources)),
f AS (SELECT trim(replace(source_file, '\\', '/')) AS path, lower(regexp_replace(coalesce(source_type, 'unknown'), '[^A-Za-z]', '', 'g')) AS kind FROM source_files)
SELECT coalesce(f.kind, '(none)') AS kind, count(*) AS mentions, count(DISTINCT s.id) AS rows FROM s LEFT JOIN f ON trim(s.path) = f.path GROUP BY 1""".replace("\\\\", "\\"))
def cited_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").select("id", F.explode(F.from_json("sources", "array<string>")).alias("p")).select("id", T.clean_path(F.col("p")).alias("path")).distinct()
    f = table(spark, d, "source_files").select(T.clean_path(F.col("source_file")).alias("path"), F.lower(F.regexp_replace(F.coalesce("source_type", F.lit("unknown")), "[^A-Za-z]", "")).alias("kind"))
    return s.join(f, "path", "left").groupBy(F.coalesce("kind", F.lit("(none)")).alias("kind")).agg(F.count("*").alias("mentions"), F.countDistinct("id").alias("rows"))


@query(f"""WITH {_LOG}, r AS (SELECT ip_hash, epoch_us(seen) AS us FROM log WHERE seen IS NOT NULL), c AS (SELECT ip_hash, us, count(*) OVER (PARTITION BY ip_hash ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM r)
SELECT ip_hash, count(*) AS rows, max(n) AS most_in_an_hour, count(*) FILTER (WHERE n > 3) AS over FROM c GROUP BY ip_hash""")
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    c = D.busiest(_log(spark, d).filter("at IS NOT NULL").select("ip_hash", F.unix_micros("at").alias("us")), "ip_hash", 3_600_000_000)
    return c.groupBy("ip_hash").agg(F.count("*").alias("rows"), F.max("n").alias("most_in_an_hour"), F.count_if(F.col("n") > 3).alias("over"))
