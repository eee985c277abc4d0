"""Keyed folds over ordered events, in bounded memory: batch and streaming twins."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import exp
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP, SLOPE, LIMIT = 0.15, 1.7, 3.0


def expected(theta: float, b: float) -> float:
    return 1.0 / (1.0 + exp(-SLOPE * (theta - b)))


def elo_step(theta: float, b: float, correct: float) -> float:
    return max(-LIMIT, min(LIMIT, theta + STEP * (correct - expected(theta, b))))


def item_difficulty(events: DataFrame) -> DataFrame:
    """(item, b): log odds of failure, smoothed and held to +-3."""
    miss, hit = F.sum(1 - F.col("p")) + 1, F.sum("p") + 1
    return events.groupBy("item").agg(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.log(miss / hit))).alias("b"))


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by user, topic and time; one running state, so a user of any length fits."""
    key, theta, n = None, 0.5, 0
    for pdf in frames:
        out = []
        for user, topic, b, p in zip(pdf["user_id"], pdf["topic"], pdf["b"], pdf["p"], strict=True):
            if (user, topic) != key:
                if key is not None:
                    out.append((*key, n, round(theta, 6)))
                key, theta, n = (user, topic), 0.5, 0
            theta, n = elo_step(theta, b, p), n + 1
        yield pd.DataFrame(out, columns=["user_id", "topic", "n", "theta"])
    if key is not None:
        yield pd.DataFrame([(*key, n, round(theta, 6))], columns=["user_id", "topic", "n", "theta"])


def elo_batch(events: DataFrame) -> DataFrame:
    """(user_id, topic, n, theta) after all events (user_id, topic, item, p, ts, event_id), against item difficulties
    taken from the whole log; users and items are so uncoupled and each key folds on its own."""
    rated = events.join(item_difficulty(events), "item").select("user_id", "topic", "ts", "event_id", "b", "p")
    ordered = rated.repartition("user_id", "topic").sortWithinPartitions("user_id", "topic", "ts", "event_id")
    return ordered.mapInPandas(_fold, "user_id bigint, topic int, n bigint, theta double")


def ema_update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Streaming twin of the closed-form mean: one value per user in the state store. A user's rows of a batch may come in several
    chunks in any order, so their times and values (16 bytes a row) are put in order first and then folded in one sum."""
    value, n = state.get if state.exists else (0.5, 0)
    parts = [(pdf["ts"].to_numpy("datetime64[us]").astype(np.int64), pdf["event_id"].to_numpy(np.int64), pdf["p"].to_numpy(np.float64)) for pdf in frames]
    ts, event, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    p = p[np.lexsort((event, ts))]
    value = value * 0.9 ** len(p) + float(np.sum(0.1 * 0.9 ** np.arange(len(p) - 1, -1, -1) * p))
    n += len(p)
    state.update((value, n))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "ema": [round(value, 6)]})


def _limit(limit: int, seconds: float):
    """Sliding limiter over rows sorted by key and time: a call is refused if ``limit`` calls of the last ``seconds`` were let
    through; refused calls don't count. Holds at most ``limit`` times of one key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, deque()
        for pdf in frames:
            out = []
            for k, i, us in zip(pdf["key"], pdf["id"], pdf["us"], strict=True):
                if k != key:
                    key, times = k, deque()
                while times and times[0] <= us - seconds * 1e6:
                    times.popleft()
                ok = len(times) < limit
                if ok:
                    times.append(us)
                out.append((k, i, ok))
            yield pd.DataFrame(out, columns=["key", "id", "allowed"])

    return run


def limited(calls: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(key, id, allowed) of calls (key, id, us) with times in microseconds. Null keys or times are left out."""
    rows = calls.filter("key IS NOT NULL AND us IS NOT NULL").select("key", "id", "us").repartition("key").sortWithinPartitions("key", "us", "id")
    return rows.mapInPandas(_limit(limit, seconds), "key string, id bigint, allowed boolean")
