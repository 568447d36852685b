"""Stateful streams over several micro-batches against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crawlweave.session import fresh_path
from crawlweave.operators import messages as MS
from crawlweave.streaming import alerts as AL
from crawlweave.streaming import queue as QU
from crawlweave.streaming import state as ST
from crawlweave.streaming import windows as WI

START = datetime(2024, 1, 1)


@pytest.fixture
def many_files(spark, tmp_path):
    """Requests in five files, read one file per micro-batch."""
    rnd = random.Random(3)
    rows = [(i, START + timedelta(milliseconds=37 * i), "hot" if rnd.random() < 0.7 else "cold", float(rnd.randrange(0, 9))) for i in range(500)]
    for b in range(5):
        part = rows[b * 100 : (b + 1) * 100]
        spark.createDataFrame(part, "id int, ts timestamp, source string, response_time double").coalesce(1).write.mode("append").parquet(str(tmp_path))
    return rows, QU.read_stream(spark, str(tmp_path), "id int, ts timestamp, source string, response_time double", files_per_batch=1)


def test_ema_over_batches(spark, many_files):
    rows, stream = many_files
    out = fresh_path(spark, "ema")
    ST.ema_stream(stream, ["ts", "id"], out, fresh_path(spark, "ck")).awaitTermination()
    want = {}
    for _, _, s, v in rows:
        old = want.get(s, 0.0)
        want[s] = v if old == 0 else old * 0.8 + v * 0.2
    got = {r.source: (r.ema, r.requests) for r in ST.latest_version(spark, out).collect()}
    assert spark.read.parquet(out).select("version").distinct().count() == 5
    for s, v in want.items():
        assert got[s][0] == pytest.approx(v) and got[s][1] == sum(r[2] == s for r in rows)


def test_token_bucket_over_batches(spark, many_files):
    rows, stream = many_files
    out = fresh_path(spark, "tb")
    WI.to_table(ST.token_bucket_stream(stream, "source", "ts", rate=10.0, burst=20), out, fresh_path(spark, "ck")).awaitTermination()
    level, last, want = {}, {}, {}
    for _, ts, s, _ in rows:
        lv = min(20.0, level.get(s, 20.0) + (ts - last.get(s, ts)).total_seconds() * 10)
        ok = lv >= 1 - 1e-9
        level[s], last[s] = lv - ok, ts
        want[s] = want.get(s, 0) + ok
    got = {r.key: r.a for r in spark.read.parquet(out).groupBy("key").agg(F.sum("allowed").alias("a")).collect()}
    assert got == want


def test_first_in_ttl_over_batches(spark, many_files):
    """A request between one and two times-to-live after the last that passed is let through."""
    rows, stream = many_files
    out = fresh_path(spark, "ttl")
    WI.to_table(QU.first_in_ttl(stream, "source", "ts", "500 milliseconds"), out, fresh_path(spark, "ck")).awaitTermination()
    last, want = {}, set()
    for i, ts, s, _ in rows:
        if s not in last or ts >= last[s] + timedelta(milliseconds=500):
            last[s] = ts
            want.add(i)
    assert {r.id for r in spark.read.parquet(out).collect()} == want and len(want) > 50


def test_stalled(spark, tmp_path):
    rows = [("a", START, "processing"), ("b", START, "processing"), ("c", START, "pending")]
    later = [("b", START + timedelta(minutes=30), "completed"), ("d", START + timedelta(hours=3), "processing")]
    last = [("e", START + timedelta(hours=4), "pending")]
    for part in (rows, later, last):
        spark.createDataFrame(part, "id string, ts timestamp, status string").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = QU.read_stream(spark, str(tmp_path), "id string, ts timestamp, status string", files_per_batch=1)
    out = fresh_path(spark, "stalled")
    WI.to_table(ST.stalled_stream(stream, "id", "ts"), out, fresh_path(spark, "ck")).awaitTermination()
    assert [r.key for r in spark.read.parquet(out).collect()] == ["a"]


def test_flow_can_be_replayed(spark, many_files):
    """Two runs over one checkpoint process every message once."""
    rows, stream = many_files
    m = stream.select("id", F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"), "source")
    out, ck = fresh_path(spark, "flow"), fresh_path(spark, "ck")
    for _ in range(2):
        QU.run_flow(m, out, ck, F.col("source") == "cold", "s").awaitTermination()
    n = {k: QU.read_flow(spark, out).filter(F.col("outcome") == k).count() for k in ("ok", "retry", "dead")}
    cold = sum(r[2] == "cold" for r in rows)
    assert n == {"ok": 500 - cold, "retry": cold, "dead": 0}


def test_held_alerts_over_batches_and_a_restart(spark, tmp_path):
    """Windows of 10 seconds with gaps and runs, one file a micro-batch; the query stops in the middle and starts again."""
    rnd = random.Random(8)
    rows = []
    for m in range(120):
        for key in ("a", "b"):
            if (m // 7 + (key == "b")) % 5:  # some stretches have no event
                rows.append((START + timedelta(seconds=10 * m + rnd.random() * 9), key, rnd.random() < (0.9 if m // 11 % 2 else 0.02)))
    src = tmp_path / "in"
    schema = "ts timestamp, key string, bad boolean"

    def put(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))

    cuts = [0, len(rows) // 4, len(rows) // 3, len(rows) // 2, len(rows)]
    out, ck = fresh_path(spark, "held"), fresh_path(spark, "ck")
    for a, b in zip(cuts, cuts[1:]):
        put(rows[a:b])
        stream = QU.read_stream(spark, str(src), schema, files_per_batch=1)
        held = AL.held_errors(stream, "ts", F.col("bad"), 0.1, "20 seconds", "10 seconds", "30 seconds", F.col("key"), "10 seconds")
        WI.to_table(held, out, ck).awaitTermination()
    got = {(r.key, r.window_start, round(r.value, 6), r.alert) for r in spark.read.parquet(out).collect()}
    windows = MS.error_windows(spark.read.schema(schema).parquet(str(src)), "ts", F.col("bad"), "20 seconds", "10 seconds", ["key"])
    twin = MS.held_for(windows, F.col("error_rate") > 0.1, "window_start", "10 seconds", "30 seconds", ["key"])
    closed = max(r[0] for r in rows) - timedelta(seconds=10)
    want = {(r.key, r.window_start, round(r.error_rate, 6), r.alert) for r in twin.collect() if r.window_start + timedelta(seconds=20) <= closed}
    assert got == want and len({x[3] for x in want}) == 2


def test_stalled_tasks_do_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(START + timedelta(minutes=rnd.randrange(4) + 3 * i), f"t{rnd.randrange(12)}", rnd.choice(["processing", "completed"])) for i in range(300)]
    schema = "ts timestamp, id string, status string"
    for i in range(0, 300, 60):
        spark.createDataFrame(rows[i : i + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = []
    for files in (1, None):
        stream = QU.read_stream(spark, str(tmp_path), schema, files_per_batch=files)
        out = fresh_path(spark, "stalled")
        WI.to_table(ST.stalled_stream(stream, "id", "ts", 3_600_000, "10 minutes"), out, fresh_path(spark, "ck")).awaitTermination()
        found.append(sorted((r.key, r.started_us) for r in spark.read.parquet(out).collect()))
    end, want = max(r[0] for r in rows) - timedelta(minutes=10), []
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[0], r[2] != "processing"))
        for a, b in zip(own, [*own[1:], None]):
            if a[2] == "processing" and ((b[0] - a[0]) if b else (end - a[0])) > timedelta(hours=1):
                want.append((key, int(a[0].timestamp() * 1_000_000)))
    assert found[0] == found[1] == sorted(want) and want
