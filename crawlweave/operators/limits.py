"""Rate limits and time-to-live over recorded requests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.operators.scan import Replay, replay_in_order

UNIT = 1_000_000_000  # one token, in the integer unit the bucket counts in


def per_minute_audit(requests: DataFrame, key: str, ts: str, limit: int) -> DataFrame:
    """(key, minute, requests, allowed, rejected): only the first ``limit`` of a minute pass."""
    return (
        requests.groupBy(key, F.date_trunc("minute", ts).alias("minute"))
        .agg(F.count("*").alias("requests"))
        .withColumn("allowed", F.least("requests", F.lit(limit)))
        .withColumn("rejected", F.col("requests") - F.col("allowed"))
    )


def per_minute_allowed(requests: DataFrame, key: str, ts: str, unique: str, limit: int) -> DataFrame:
    """The requests that pass. The rank filter is applied per map task before the shuffle."""
    w = W.partitionBy(key, "minute").orderBy(ts, unique)
    return (
        requests.withColumn("minute", F.date_trunc("minute", ts))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
    )


def _micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970; a time without zone counts as UTC whatever the session zone is."""
    c = F.col(ts)
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        c = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c)
    return F.unix_micros(c.cast("timestamp"))


def _ticks(requests: DataFrame, key: str, ts: str) -> DataFrame:
    return requests.groupBy(F.col(key).cast("string").alias("key"), _micros(requests, ts).alias("t")).agg(
        F.count("*").alias("n")
    )


class TokenBucket(Replay):
    """Tokens refill at ``rate`` per second up to ``burst``; a request needs one whole token.

    State is [last tick, level], level in integer units so that a replay is exact.
    """

    def __init__(self, rate: float, burst: int):
        self.per_us = round(rate * UNIT / 1_000_000)
        self.cap = burst * UNIT

    def run(self, t, n, state):
        last, level = state if state is not None else (int(t[0]), self.cap)
        passed = np.empty(len(t), dtype="int64")
        for i, (ti, ni) in enumerate(zip(t.tolist(), n.tolist())):
            level = min(self.cap, level + (ti - last) * self.per_us)
            take = min(ni, level // UNIT)
            level -= take * UNIT
            passed[i], last = take, ti
        return passed, [last, level]

    def effect(self, t, n):
        """Either a fixed end level, or the numbers that give it for a start level.

        ``low`` is a bucket that starts empty and serves fractions: it never holds more
        than the real one, so when it is full the real one is full whatever came before.
        While nothing overflows, the requests passed are
        ``demand + min(0, whole start tokens + min_j(whole refill_j - demand_j))``, where the
        inner minimum depends on the start only through its fraction: one more when the
        start fraction carries into a whole token at every tick that attains the minimum.
        """
        per_us, cap = self.per_us, self.cap
        t0, prev = int(t[0]), int(t[0])
        low = low_top = 0
        demand, least, frac, top = 0, None, 0, 0
        for i, (ti, ni) in enumerate(zip(t.tolist(), n.tolist())):
            if low + (ti - prev) * per_us >= cap and i:
                end = self.run(t[i:], n[i:], [ti, cap])[1]
                return {"end": end}
            low += (ti - prev) * per_us
            low_top = max(low_top, low)
            refill = (ti - t0) * per_us
            top = max(top, refill - demand * UNIT)
            demand += ni
            low = max(0, low - ni * UNIT)
            gap, part = refill // UNIT - demand, refill % UNIT
            if least is None or gap < least:
                least, frac = gap, part
            elif gap == least:
                frac = min(frac, part)
            prev = ti
        return {
            "t0": t0, "t1": prev, "refill": (prev - t0) * per_us, "demand": demand,
            "least": least, "frac": frac, "top": top, "low_top": low_top,
        }

    def apply(self, effect, state):
        if "end" in effect:
            return effect["end"]
        if state is None:
            state = [effect["t0"], self.cap]
        level = min(self.cap, state[1] + (effect["t0"] - state[0]) * self.per_us)
        overflow = level + effect["top"] > self.cap or effect["low_top"] + UNIT > self.cap
        if overflow:
            return NotImplemented
        whole, fraction = divmod(level, UNIT)
        least = effect["least"] + (1 if fraction + effect["frac"] >= UNIT else 0)
        passed = effect["demand"] + min(0, whole + least)
        return [effect["t1"], level + effect["refill"] - passed * UNIT]


class TimeToLive(Replay):
    """A tick passes when nothing passed during the ``ttl`` before it. State is the last passing time."""

    MAX_STEPS = 1000

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def run(self, t, n, state):
        passed = np.zeros(len(t), dtype="int64")
        i = 0 if state is None else int(np.searchsorted(t, state + self.ttl))
        while i < len(t):
            passed[i], state = 1, int(t[i])
            i = int(np.searchsorted(t, state + self.ttl))
        return passed, state

    def effect(self, t, n):
        """Step function: start + ttl up to ``upto[k]`` ends at ``ends[k]``."""
        follow = np.searchsorted(t, t + self.ttl)
        end = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if follow[i] < len(t):
                end[i] = end[follow[i]]
        # a start lies before the run, so only its first ttl can hold the first passing tick
        reach = int(np.searchsorted(t, t[0] + self.ttl))
        reach = min(len(t), reach + 1)
        last = np.flatnonzero(np.append(end[1:reach] != end[: reach - 1], True))
        if len(last) > self.MAX_STEPS:
            return {}
        return {"t0": int(t[0]), "upto": t[last].tolist(), "ends": t[end[last]].tolist()}

    def apply(self, effect, state):
        if not effect:
            return NotImplemented
        due = effect["t0"] if state is None else state + self.ttl
        for upto, end in zip(effect["upto"], effect["ends"]):
            if due <= upto:
                return end
        return state


def token_bucket_audit(requests: DataFrame, key: str, ts: str, rate: float = 10.0, burst: int = 20) -> DataFrame:
    """(key, t, n, passed): requests at each instant and how many found a token."""
    return replay_in_order(_ticks(requests, key, ts), TokenBucket(rate, burst))


def within_ttl(requests: DataFrame, key: str, ts: str, ttl_seconds: int = 3600) -> DataFrame:
    """(key, t, n, passed): passed is 1 where the request is answered afresh, 0 inside the time-to-live."""
    return replay_in_order(_ticks(requests, key, ts), TimeToLive(ttl_seconds * 1_000_000))


def limit_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("key").agg(
        F.sum("n").alias("requests"), F.sum("passed").alias("allowed"), (F.sum("n") - F.sum("passed")).alias("rejected")
    )
