"""Bucketed tables with versions: a merge rewrites only the buckets that its changes touch.

Rows lie in ``data/batch=<n>/bucket=<b>``, b being the hash of the key. ``manifest/batch=<n>`` names for each bucket the batch that
wrote it last, and is written after the data: a version is there as a whole or not at all. Readers take one version. A batch
that is merged again, after a failure in its middle or behind it, overwrites what it had written or changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlweave.operators.maintain import merge_rows
from crawlweave.session import materialize

BUCKETS = 64
MANIFEST = "bucket int, written long, buckets int, ddl string"
WHOLE = -1  # the manifest's row for the table itself


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, batch: int, kept: dict[int, int], buckets: int, ddl: str) -> None:
    """``rows`` (with ``bucket``) and the manifest that adds them to the buckets ``kept``."""
    spark = rows.sparkSession
    data = f"{path}/data/batch={batch}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    found = spark.read.schema(f"{ddl}, bucket int").parquet(data).select("bucket").distinct().collect()
    entries = {**kept, **{r["bucket"]: batch for r in found}, WHOLE: batch}
    manifest = spark.createDataFrame([(b, w, buckets, ddl) for b, w in sorted(entries.items())], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the versions that are there, oldest first; expiry keeps them few."""
    found = spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{path}/manifest").filter(F.col("bucket") == WHOLE)
    return sorted(r["batch"] for r in found.select("batch").collect())


def _manifest(spark: SparkSession, path: str, batch: int | None) -> tuple[int, dict[int, int], int, str]:
    batch = versions(spark, path)[-1] if batch is None else batch
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/batch={batch}").collect()  # a row a bucket
    return batch, {r["bucket"]: r["written"] for r in rows if r["bucket"] != WHOLE}, rows[0]["buckets"], rows[0]["ddl"]


def _read(spark: SparkSession, path: str, entries: dict[int, int], ddl: str) -> DataFrame:
    if not entries:
        return spark.createDataFrame([], ddl)
    folders = [f"{path}/data/batch={w}/bucket={b}" for b, w in sorted(entries.items())]
    return spark.read.schema(ddl).parquet(*folders)


def create_table(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, batch: int = 0) -> None:
    _write(rows.withColumn("bucket", bucket_of(key, buckets)), path, batch, {}, buckets, _ddl(rows))


def read_table(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default."""
    _, entries, _, ddl = _manifest(spark, path, batch)
    return _read(spark, path, entries, ddl)


def read_key(spark: SparkSession, path: str, key: str, value, batch: int | None = None) -> DataFrame:
    """The rows of one key; only its bucket is read."""
    _, entries, buckets, ddl = _manifest(spark, path, batch)
    kind = {f.name: f.dataType for f in spark.createDataFrame([], ddl).schema.fields}[key]
    bucket = spark.range(1).select(F.lit(value).cast(kind).alias(key)).select(bucket_of(key, buckets)).first()[0]
    return _read(spark, path, {b: w for b, w in entries.items() if b == bucket}, ddl).filter(F.col(key) == F.lit(value))


def merge_bucketed(changes: DataFrame, path: str, key: str, version: str, batch: int, deleted: str = "deleted") -> list[int]:
    """Merge a change batch as ``merge_rows`` does; returns the buckets it wrote, none if the batch had been merged."""
    spark = changes.sparkSession
    last, entries, buckets, ddl = _manifest(spark, path, None)
    if batch <= last:
        return []
    changes = materialize(changes, "changes")
    touched = [r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect()]  # at most a row a bucket
    old = _read(spark, path, {b: entries[b] for b in touched if b in entries}, ddl)
    merged = merge_rows(old, changes, key, version, deleted).withColumn("bucket", bucket_of(key, buckets))
    _write(merged, path, batch, {b: w for b, w in entries.items() if b not in touched}, buckets, ddl)
    return sorted(touched)


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all versions but the newest ``keep``, and the buckets that only those used."""
    found = versions(spark, path)
    used = {(w, b) for v in found[-keep:] for b, w in _manifest(spark, path, v)[1].items()}
    jvm = spark.sparkContext._jvm
    folder = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
    fs = folder().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for v in found[:-keep]:  # first the versions, so that none names what is gone
        fs.delete(folder("manifest", f"batch={v}"), True)
    for written in fs.listStatus(folder("data")):
        name = written.getPath().getName()
        batch = int(name.split("=")[1])
        if batch > found[-1]:
            continue  # a merge that has not ended
        buckets = [s.getPath().getName() for s in fs.listStatus(written.getPath()) if s.isDirectory()]
        gone = [b for b in buckets if (batch, int(b.split("=")[1])) not in used]
        if len(gone) == len(buckets):
            fs.delete(written.getPath(), True)
        for b in gone if len(gone) < len(buckets) else []:
            fs.delete(folder("data", name, b), True)


def merge_stream(
    df: DataFrame, path: str, key: str, checkpoint: str, every: str | None = None, keep: int = 2, on_batch: Callable[[int, list[int]], None] | None = None
) -> StreamingQuery:
    """Keep a table up to date from an aggregate in ``update`` mode: each micro-batch brings the changed keys only."""
    columns = _ddl(df)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            create_table(spark.createDataFrame([], columns), path, key, batch=-1)
        changes = batch.withColumns({"deleted": F.lit(False), "_version": F.lit(number)})
        wrote = merge_bucketed(changes, path, key, "_version", number)
        expire(spark, path, keep)
        if on_batch:
            on_batch(number, wrote)

    w = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()
