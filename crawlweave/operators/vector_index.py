"""Inverted-file index of vectors: k-means cells, many queries a job, and an exact stop.

Vectors are scaled to length 1, where the cosine distance is half the squared distance. A query probes the cells whose
centres are nearest. It is exact once no other cell can hold a nearer vector: a cell's members lie within its radius of
its centre, so distance to the centre less the radius bounds them from below. ``probes`` limits the cells instead.

Centres are learned from at most ``SAMPLE`` vectors, the ones with the smallest hashed ids, and there are at most ``MOST_CELLS``; both
bound what is broadcast. Every vector is indexed. A cell is stored in parts of about ``PART_ROWS``, so a cell with most of the vectors
is many tasks. Vectors without a direction (null, empty or all zero) have no distance and are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 50_000
MOST_CELLS = 1_024
PART_ROWS = 20_000
QUERY_SLICE = 512


def _unit(v: Column) -> Column:
    """The vector at length 1, null if it has no direction."""
    wide = F.transform(v, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length))


def _apart(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def build_index(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 7) -> None:
    """``path/cells`` (cell, centre, radius, n, parts) and ``path/rows`` (id, unit) by cell and part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), _unit(F.col(vector)).alias("unit")).filter("unit IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
    n = sample.count()
    if not n:
        raise ValueError("no vector has a direction")
    k = max(1, min(cells or int(n**0.5), MOST_CELLS, n))
    model = KMeans(k=k, seed=seed, maxIter=15).fit(sample) if k > 1 else None
    centres = [[float(x) for x in c] for c in model.clusterCenters()] if model else [rows.first()["unit"]]
    known = vectors.sparkSession.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    if model:
        placed = model.transform(rows.withColumn("features", array_to_vector("unit"))).select("id", "unit", F.col("prediction").alias("cell"))
    else:
        placed = rows.withColumn("cell", F.lit(0))
    placed = placed.join(F.broadcast(known), "cell").withColumn("gap", _apart(F.col("unit"), F.col("centre"))).drop("centre")
    sizes = placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
    sizes = known.join(sizes, "cell").withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    parts = vectors.sparkSession.read.parquet(f"{path}/cells").select("cell", "parts")
    split = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split.select("id", "unit", "cell", "part").hint("rebalance", "cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without a Python number for each value."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]).reshape(len(vectors), -1)


def _least(ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest distances, ties by id; only those up to the k-th distance are sorted."""
    if len(ids) <= k:
        return np.lexsort((ids, distance))
    near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    return near[np.lexsort((ids[near], distance[near]))[:k]]


def _probe(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance): the ``k`` nearest of each part that a query asks."""

    def nearest(here: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if here.num_rows and asked.num_rows:
            ids, unit = here["id"].to_numpy(), _matrix(here["unit"])
            for lo in range(0, asked.num_rows, QUERY_SLICE):
                some = asked.slice(lo, QUERY_SLICE)
                far = np.round(1 - _matrix(some["q"]) @ unit.T, 12)
                for query, d in zip(some["query_id"].to_pylist(), far, strict=True):
                    best = _least(ids, d, k)
                    found.append((np.full(len(best), query, np.int64), ids[best], d[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "id", "distance"), columns, strict=True)))

    left, right = rows.groupBy("cell", "part"), wanted.groupBy("cell", "part")
    return left.cogroup(right).applyInArrow(nearest, "query_id long, id long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) for ``queries`` (query_id, embedding); exact unless ``probes`` limits the cells of a query."""
    cells = spark.read.parquet(f"{path}/cells")  # at most MOST_CELLS rows
    rows = spark.read.parquet(f"{path}/rows").select("id", "unit", F.col("cell").cast("int").alias("cell"), "part")
    every = cells.agg(F.collect_list(F.struct("cell", "centre", "radius", "parts"))).scalar()
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), _unit(F.col("embedding")).alias("q")).filter("q IS NOT NULL")
    ranked = F.array_sort(F.transform(F.col("_cells"), lambda c: F.struct(_apart(F.col("q"), c["centre"]).alias("gap"), c["cell"].alias("cell"), c["radius"].alias("radius"), c["parts"].alias("parts"))))
    asked = asked.withColumn("_cells", every).withColumn("order", ranked).drop("_cells")

    def parts_of(chosen: DataFrame) -> DataFrame:
        each = chosen.select("query_id", "q", F.explode("some").alias("c"))
        return each.select("query_id", "q", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("c.parts") - 1)).alias("part"))

    first = probes or 2
    near = _best(_probe(rows, parts_of(asked.withColumn("some", F.slice("order", 1, first))), k), k)
    if probes:
        return near.select("query_id", "rank", "id", "distance")
    reached = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
    # cosine distance d is a distance of sqrt(2 d) between unit vectors
    limit = F.when(F.col("n") == k, F.sqrt(2 * F.greatest("worst", F.lit(0.0))) + 1e-6).otherwise(F.lit(float("inf")))
    rest = asked.join(reached, "query_id", "left").withColumn("_limit", F.coalesce(limit, F.lit(float("inf"))))
    open_cells = F.filter(F.slice("order", first + 1, MOST_CELLS), lambda c: c["gap"] - c["radius"] <= F.col("_limit"))
    more = _probe(rows, parts_of(rest.withColumn("some", open_cells)), k)
    return _best(near.select("query_id", "id", "distance").unionByName(more), k).select("query_id", "rank", "id", "distance")
