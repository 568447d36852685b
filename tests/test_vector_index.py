"""Inverted-file index: exact against brute force, recall with few probes, hot cells in several parts."""

import numpy as np
import pytest

from crawlweave.operators import vector_index as VX
from crawlweave.session import fresh_path

N, DIM, K = 1_500, 12, 7


@pytest.fixture(scope="module")
def indexed(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, DIM))
    v = centres[rng.integers(0, 20, N)] + 0.25 * rng.normal(size=(N, DIM))
    v[100:130] = v[99]  # copies
    v[200:700] = centres[0] + 0.05 * rng.normal(size=(500, DIM))  # a cell with a third of all
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(9_000, [0.0] * DIM), (9_001, None)]
    path = fresh_path(spark, "vectors")
    before, VX.PART_ROWS = VX.PART_ROWS, 100
    VX.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), path, cells=25)
    VX.PART_ROWS = before
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, N, 50)] + [(9_000, [0.0] * DIM)], "query_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in range(0, N, 50):
        d = np.round(1 - unit @ unit[q], 12)
        want[q] = [int(i) for i in np.lexsort((np.arange(N), d))[:K]]
    return path, asked, want


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_search_is_exact(spark, indexed):
    path, asked, want = indexed
    assert answers(VX.search(spark, path, asked, K)) == want


def test_recall_with_few_probes(spark, indexed):
    path, asked, want = indexed
    got = answers(VX.search(spark, path, asked, K, probes=5))
    assert np.mean([len(set(got[q]) & set(w)) / K for q, w in want.items()]) >= 0.9


def test_every_vector_with_a_direction_is_indexed(spark, indexed):
    path, _, _ = indexed
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == N and rows.select("id").distinct().count() == N
    cells = {r["cell"]: r for r in spark.read.parquet(f"{path}/cells").collect()}
    assert max(c["parts"] for c in cells.values()) > 1 and sum(c["n"] for c in cells.values()) == N
