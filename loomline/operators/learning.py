"""Interaction analytics and recommenders on an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _marked(df: DataFrame, keys: list[str], start: str, end: str, order: list[str], gap_minutes: int) -> DataFrame:
    """Running number of the session within ``keys``: a new one begins where ``gap_minutes`` pass after the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(end).over(w)
    new = F.when(before.isNull() | (F.col(start) > before + F.expr(f"INTERVAL {gap_minutes} MINUTES")), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(events: DataFrame, gap_minutes: int = 360) -> DataFrame:
    """(user_id, session_no, start, end, events): a session ends where ``gap_minutes`` pass without an event.

    Events are first joined to sessions inside each day of a user, which spreads a hot user over tasks; then the days'
    sessions, a few rows each, are joined across midnight in the same way.
    """
    days = events.withColumn("_day", F.to_date("ts"))
    local = _marked(days, ["user_id", "_day"], "ts", "ts", ["ts", "event_id"], gap_minutes)
    parts = local.groupBy("user_id", "_day", "_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("_no")
    whole = _marked(parts, ["user_id"], "start", "end", ["start"], gap_minutes)
    return whole.groupBy("user_id", F.col("_no").alias("session_no")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("events"))


def last_n(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each user, by time and id; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)


def moving_mean(daily: DataFrame, value: str, days: int = 7) -> DataFrame:
    """Trailing mean over the observed days, shorter at the start. ``daily`` has one row a day and group."""
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-(days - 1), 0)
    return daily.withColumn("moving_mean", F.round(F.avg(value).over(w), 6))


def ema(events: DataFrame, keep: float = 0.9, start: float = 0.5) -> DataFrame:
    """(user_id, n, ema) of v <- keep * v + (1 - keep) * p in order of time, in closed form: each event weighs
    (1 - keep) * keep^(events after it). Days of a user are summed on their own and then joined by the number of
    events after each day, so no user's events are held together or sorted in one task."""
    w = Window.partitionBy("user_id", "_day").orderBy(F.desc("ts"), F.desc("event_id"))
    later = Window.partitionBy("user_id").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    after = events.withColumn("_day", F.to_date("ts")).withColumn("_after", F.row_number().over(w) - 1)
    days = after.groupBy("user_id", "_day").agg(F.count("*").alias("n"), F.sum((1 - keep) * F.pow(F.lit(keep), F.col("_after")) * F.col("p")).alias("s"))
    placed = days.withColumn("_later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    n = F.sum("n")
    return placed.groupBy("user_id").agg(n.alias("n"), F.round(F.sum(F.col("s") * F.pow(F.lit(keep), F.col("_later"))) + start * F.pow(F.lit(keep), n), 6).alias("ema"))


def mastery(events: DataFrame) -> DataFrame:
    """(user_id, topic, n, rate, state): share of successes and the state it stands for."""
    g = events.groupBy("user_id", "topic").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("rate"))
    state = F.when(F.col("n") < 3, "new").when(F.col("rate") >= 0.7, "advanced").when(F.col("rate") < 0.3, "struggling").otherwise("learning")
    return g.withColumn("state", state)


def overall_state(m: DataFrame) -> DataFrame:
    share = lambda s: F.count_if(F.col("state") == s) / F.count("*")
    return m.groupBy("user_id").agg(
        F.count("*").alias("topics"), F.when(share("struggling") >= 0.6, "struggling").when(share("advanced") >= 0.6, "advanced").otherwise("learning").alias("overall")
    )


def style(events: DataFrame) -> DataFrame:
    """Explorer, deep diver or balanced, by how a user's events spread over topics."""
    per = events.groupBy("user_id", "topic").agg(F.count("*").alias("c"))
    g = per.groupBy("user_id").agg(F.count("*").alias("topics"), F.max("c").alias("most"), F.avg("c").alias("mean"))
    kind = F.when((F.col("topics") >= 4) & (F.col("most") <= 1.5 * F.col("mean")), "explorer").when((F.col("topics") <= 2) & (F.col("most") >= 5), "deep_diver").otherwise("balanced")
    return g.select("user_id", "topics", "most", kind.alias("style"))


def leave_last_out(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and test: the last event of each user with at least two is the test. The last event is an aggregate with
    map-side combine; the rest is found by the id of the event, so a hot user makes no hot task."""
    rest = [c for c in events.columns if c != "user_id"]
    last = events.groupBy("user_id").agg(F.count("*").alias("_n"), F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r"))
    test = last.filter("_n >= 2").select("user_id", "r.*").select(*events.columns)
    return events.join(test.select("event_id"), "event_id", "left_anti").select(*events.columns), test


def popularity_metrics(train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate, NDCG and mean average precision at k of recommending the most frequent items of the training part."""
    pop = train.groupBy("item").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "item").limit(k)
    ranked = pop.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("c"), "item")))
    hit = test.join(F.broadcast(ranked), "item", "left")
    rank = F.col("rank")
    return hit.agg(
        F.count("*").alias("users"), F.round(F.avg(rank.isNotNull().cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.log2(rank + 1.0), F.lit(0.0))), 6).alias("ndcg"), F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("map"),
    )


def rating_target(feedback: Column) -> Column:
    """A rating of 1 to 10 as a target in [0, 1], a thumb down (-1) as 0; any other feedback gives none."""
    return F.when(feedback.between(1, 10), (feedback - 1) / 9.0).when(feedback == -1, F.lit(0.0))


def clipped_fold(events: DataFrame, keys: list[str], step: str, start: int, low: int, high: int, slice_rows: int = 1000) -> DataFrame:
    """(keys, n, value) of value <- min(high, max(low, value + step)) in order of ts and event_id; steps are whole numbers.

    Steps of that kind compose to one more of their kind: an addition and two bounds. So slices of a key, cut by day and by
    ``slice_rows``, are each folded to three numbers, and only these meet at the key. Null steps count as 0.
    """
    w = Window.partitionBy(*keys, "_day").orderBy("ts", "event_id")
    cut = events.withColumn("_day", F.to_date("ts")).withColumn("_slice", F.floor((F.row_number().over(w) - 1) / slice_rows))
    one = F.struct(F.col("ts"), F.col("event_id"), F.coalesce(F.col(step), F.lit(0)).cast("bigint").alias("by"))
    bound = lambda c: F.least(F.lit(high).cast("bigint"), F.greatest(F.lit(low).cast("bigint"), c))
    none = F.struct(F.lit(0).cast("bigint").alias("add"), F.lit(low).cast("bigint").alias("least"), F.lit(high).cast("bigint").alias("most"))
    after = lambda acc, x: F.struct((acc["add"] + x["by"]).alias("add"), bound(acc["least"] + x["by"]).alias("least"), bound(acc["most"] + x["by"]).alias("most"))
    parts = cut.groupBy(*keys, "_day", "_slice").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("steps"))
    folded = parts.select(*keys, "_day", "_slice", "n", F.aggregate("steps", none, after).alias("f"))
    whole = folded.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_day", "_slice", "f"))).alias("fs"))
    value = F.aggregate("fs", F.lit(start).cast("bigint"), lambda v, x: F.least(x["f"]["most"], F.greatest(x["f"]["least"], v + x["f"]["add"])))
    return whole.select(*keys, "n", value.alias("value"))


def anchored(candidates: DataFrame, abilities: DataFrame, default: float = 0.5) -> DataFrame:
    """candidates (user_id, topic, difficulty, ...) with ``anchor``, ``known`` and ``gap`` = |difficulty - anchor|. The anchor is the user's ability (user_id,
    topic, theta; one row a user and topic) in the topic's lower-case spelling, else in its own, else ``default``; a difficulty that is null or 0 counts as ``default``."""
    low = abilities.select("user_id", F.col("topic").alias("_low"), F.col("theta").alias("_by_low"))
    own = abilities.select("user_id", "topic", F.col("theta").alias("_by_own"))
    j = candidates.withColumn("_low", F.lower("topic")).join(low, ["user_id", "_low"], "left").join(own, ["user_id", "topic"], "left")
    theta = F.coalesce("_by_low", "_by_own")
    j = j.withColumn("known", theta.isNotNull()).withColumn("anchor", F.coalesce(theta, F.lit(default)))
    return j.withColumn("gap", F.abs(F.coalesce(F.nullif("difficulty", F.lit(0.0)), F.lit(default)) - F.col("anchor"))).drop("_low", "_by_low", "_by_own")
