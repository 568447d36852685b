"""Bucketed tables with versions: what merges write, replays, expiry, and streams that feed them."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crawlweave.session import fresh_path
from crawlweave.sources import versioned as VT
from crawlweave.streaming import queue as QU


@pytest.fixture
def path(spark):
    out = fresh_path(spark, "versioned")
    rows = spark.range(200).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("timestamp").alias("at"))
    VT.create_table(rows, out, "id", 8)
    return out


def changes(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, at timestamp, deleted boolean, version long")


def files(path):
    local = path.removeprefix("file:")
    return {str(p.relative_to(local)) for p in Path(local).rglob("*.parquet")}


def content(spark, path, batch=None):
    return {r["id"]: r["name"] for r in VT.read_table(spark, path, batch).collect()}


def test_a_merge_rewrites_touched_buckets_only(spark, path):
    before, names = files(path), content(spark, path)
    wrote = VT.merge_bucketed(changes(spark, [(5, "five", None, False, 1), (5, "old", None, False, 0), (7, None, None, True, 1)]), path, "id", "version", 1)
    new = {f for f in files(path) - before if f.startswith("data")}
    assert len(wrote) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in new} == set(wrote)
    assert before <= files(path)
    want = {**names, 5: "five"}
    del want[7]
    assert content(spark, path) == want and content(spark, path, 0) == names
    assert VT.read_key(spark, path, "id", 5).collect()[0]["name"] == "five"
    read = VT.read_key(spark, path, "id", 5).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in read} <= {str(b) for b in wrote}


def test_a_batch_merged_again_changes_nothing(spark, path):
    batch = changes(spark, [(300, "new", None, False, 1)])
    VT.merge_bucketed(batch, path, "id", "version", 1)
    after = files(path)
    assert VT.merge_bucketed(batch, path, "id", "version", 1) == [] and files(path) == after


def test_a_merge_that_fails_before_its_manifest_is_not_seen(spark, path, monkeypatch):
    names, batch = content(spark, path), changes(spark, [(0, "zero", None, False, 1), (1, None, None, True, 1)])
    create = type(spark).createDataFrame

    def fail(self, data, *a, **k):
        if a and a[0] == VT.MANIFEST:
            raise RuntimeError("lost")
        return create(self, data, *a, **k)

    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    with pytest.raises(RuntimeError):
        VT.merge_bucketed(batch, path, "id", "version", 1)
    monkeypatch.undo()
    assert content(spark, path) == names
    VT.expire(spark, path, 1)  # leaves what a running merge has written
    VT.merge_bucketed(batch, path, "id", "version", 1)
    want = {**names, 0: "zero"}
    del want[1]
    assert content(spark, path) == want


def test_a_table_may_become_empty_and_fill_again(spark):
    out = fresh_path(spark, "versioned")
    VT.create_table(changes(spark, []).drop("deleted", "version"), out, "id", 4)
    assert content(spark, out) == {}
    VT.merge_bucketed(changes(spark, [(1, "a", None, False, 1)]), out, "id", "version", 1)
    VT.merge_bucketed(changes(spark, [(1, "a", None, True, 2)]), out, "id", "version", 2)
    assert content(spark, out) == {}
    VT.merge_bucketed(changes(spark, [(1, "b", None, False, 1)]), out, "id", "version", 3)
    assert content(spark, out) == {1: "b"}


def test_progress_stream_writes_changed_keys_and_stays_small(spark, tmp_path):
    schema = "job long, n long"
    for b in range(20):
        rows = [(j, 1) for j in range(40)] if b == 0 else [(b % 3, 1), (b % 3, 1)]
        part = tmp_path / "in" / f"{b:02d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        os.utime(part, (b + 1, b + 1))
        for f in part.glob("*.parquet"):
            os.utime(f, (1000 + b, 1000 + b))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out, ck, wrote, sizes = fresh_path(spark, "progress"), fresh_path(spark, "ck"), [], []

    def seen(number, buckets):
        wrote.append(len(buckets))
        sizes.append(len(files(out)))

    VT.merge_stream(stream.groupBy("job").agg(F.sum("n").alias("n")), out, "job", ck, keep=2, on_batch=seen).awaitTermination()
    want = {j: 1 for j in range(40)}
    for b in range(1, 20):
        want[b % 3] += 2
    assert {r["job"]: r["n"] for r in VT.read_table(spark, out).collect()} == want
    assert len(wrote) == 20 and max(wrote[1:]) == 1
    assert max(sizes) <= sizes[0] + 6 and len(VT.versions(spark, out)) == 2


def test_flow_that_fails_in_mid_batch_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    schema = "id int, bad boolean, retry_count int, max_retries int"
    for b in range(4):
        rows = [(10 * b + i, i % 3 == 0, i % 5, 3) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    out, ck, range_ = fresh_path(spark, "flow"), fresh_path(spark, "ck"), type(spark).range

    def fail(self, start, end=None, *a, **k):
        if (start, end) == (2, 3):
            raise RuntimeError("lost after the data was written")
        return range_(self, start, end, *a, **k)

    def run():
        stream = QU.read_stream(spark, str(tmp_path), schema, files_per_batch=1)
        q = QU.run_flow(stream, out, ck, F.col("bad"), "s")
        q.awaitTermination()

    monkeypatch.setattr(type(spark), "range", fail)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    assert QU.read_flow(spark, out).count() == 20  # the written batch is not committed
    run()
    got = QU.read_flow(spark, out).collect()
    assert sorted(r["id"] for r in got) == list(range(40))
    for r in got:
        i = r["id"] % 10
        assert r["outcome"] == ("ok" if i % 3 else "dead" if i % 5 >= 3 else "retry")
        assert r["retry_count"] == i % 5 + (r["outcome"] == "retry") and (r["error"] is not None) == (r["outcome"] == "dead")
