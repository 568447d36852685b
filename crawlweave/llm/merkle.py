"""Merkle manifest of a dataset, with octopus multiproofs.

H is the lower-case hex SHA-256 of its inputs, one after the other; digests enter as hex text. A row's leaf is H of its
fields, each ``-`` if null and otherwise its UTF-8 byte count, ``:`` and its value. Each group (null is one) is a tree:
its leaves stand in the order of their keys, and every two neighbours become their H, a last single one too, until
one is left. The groups' roots, in the order of the groups (null first, then by bytes), are the leaves of the top tree.

Leaves are computed once, where the rows are read; texts are not shuffled. Spark range-partitions the leaves by group,
key, digest and row, and the place in that order plus the counts of earlier ranges give each leaf its place in its tree,
so a group with most of the rows is spread like any other. ``2 ** band`` neighbouring leaves are a leaf partition. Each
is reduced to its top node, those are reduced ``band`` levels further, and so on.

Octopus multiproof: a leaf partition computes the minimal union of node coordinates that its leaves' proofs need and
that it can't derive from its own leaves, fetches these nodes by one join, derives the interior nodes which its proofs
share, and expands the single proofs from them. A node near the root is wanted by very many partitions: it is
repeated for every ``2 ** band`` of them, so no key of the join is hot.

Defined cases: a null key comes first; rows of one key are ordered by their leaves. Repeated rows are leaves of their own.
A tree of one leaf is that leaf. An empty table has no tree and no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.operators.skew import is_small, join_lookup
from crawlweave.session import materialize

BAND = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, levels int, height int, idx long, digest string"


def encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def missing_nodes(held: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(height, index) of the nodes that proofs of the leaves ``held`` need and these leaves don't give: the octopus union."""
    held, out, height = np.unique(np.asarray(held, np.int64)), [], 0
    while size > 1:
        siblings = held ^ 1
        away = siblings[(siblings < size) & ~np.isin(siblings, held)]
        out += [(height, int(i)) for i in away]
        held, size, height = np.unique(held >> 1), (size + 1) // 2, height + 1
    return out


def next_level(nodes: list[str]) -> list[str]:
    return [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def step(node: str, index: int, sibling: str | None) -> str:
    """The parent of ``node``, from the sibling of its pair if there is one."""
    if sibling is None:
        return H(node)
    return H(sibling, node) if index & 1 else H(node, sibling)


def placed_leaves(leaves: DataFrame, order: Sequence[str], band: int = BAND) -> DataFrame:
    """``leaves`` (with ``tree``) with ``place`` in their tree, ``size`` and ``levels`` of the tree, and ``cell``."""
    sort = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    rows = leaves.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "merkle-leaves").withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "tree", "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(by_tree).alias("size")
    )
    runs = runs.withColumn("levels", F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0).cast("int"))
    runs = materialize(runs, "merkle-runs")  # at most one row for each tree and each range
    found = rows.join(F.broadcast(runs) if is_small(runs) else runs, ["tree", "_range"])
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return found.withColumn("place", place).withColumn("cell", F.shiftright("place", band)).drop("_at", "_range", "_first", "_before")


def _nodes(tree: str, levels: int, rows: list[tuple[int, int, str]]) -> pa.Table:
    heights, places, digests = zip(*rows, strict=True) if rows else ((), (), ())
    n = len(rows)
    return pa.table({
        "tree": pa.array([tree] * n, pa.string()), "levels": pa.array([levels] * n, pa.int32()), "height": pa.array(heights, pa.int32()),
        "idx": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.string()),
    })


def reduce_leaves(table: pa.Table, band: int) -> pa.Table:
    """The top node of one leaf partition."""
    table = table.sort_by("place")
    nodes, levels, height = table["leaf"].to_pylist(), table["levels"][0].as_py(), 0
    while height < min(band, levels):
        nodes, height = next_level(nodes), height + 1
    return _nodes(table["tree"][0].as_py(), levels, [(height, table["cell"][0].as_py(), nodes[0])])


def reduce_nodes(table: pa.Table, band: int) -> pa.Table:
    """All nodes above neighbouring nodes of one height, up to ``band`` levels."""
    table = table.sort_by("idx")
    nodes, levels, height = table["digest"].to_pylist(), table["levels"][0].as_py(), table["height"][0].as_py()
    first, rows = table["idx"][0].as_py(), []
    for _ in range(min(band, levels - height)):
        nodes, first, height = next_level(nodes), first >> 1, height + 1
        rows += [(height, first + i, d) for i, d in enumerate(nodes)]
    return _nodes(table["tree"][0].as_py(), levels, rows)


def upper_nodes(placed: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes at and above the top nodes of the leaf partitions; one in 2 ** (band - 1) leaves or so."""
    slim = placed.select("tree", "levels", "cell", "place", "leaf")
    new = materialize(slim.groupBy("tree", "cell").applyInArrow(lambda t: reduce_leaves(t, band), NODE), "merkle-nodes")
    found, height = new, band
    while new.filter((F.col("height") == height) & (F.col("height") < F.col("levels"))).limit(1).count():
        tops = new.filter((F.col("height") == height) & (F.col("height") < F.col("levels"))).withColumn("_run", F.shiftright("idx", band))
        new = materialize(tops.groupBy("tree", "_run").applyInArrow(lambda t: reduce_nodes(t, band), NODE), "merkle-nodes")
        found, height = found.unionByName(new), height + band
    return found


def fetched_nodes(placed: DataFrame, nodes: DataFrame, band: int = BAND) -> DataFrame:
    """(tree, cell, fetched): for each leaf partition the nodes that its proofs lack."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [
                    (r["tree"], r["cell"], h, i) for r in part.to_pylist() for h, i in missing_nodes(np.arange(r["a"], r["b"] + 1), r["size"])
                ]
                tree, cell, height, idx = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree, pa.string()), pa.array(cell, pa.int64()), pa.array(height, pa.int32()), pa.array(idx, pa.int64())],
                    names=["tree", "cell", "height", "idx"],
                )

    parts = placed.groupBy("tree", "cell").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.first("size").alias("size"))
    want = parts.mapInArrow(wanted, "tree string, cell long, height int, idx long").withColumn("share", F.shiftright("cell", band))
    # the partitions below a node's sibling want the node
    low = F.expr(f"shiftright(shiftleft(idx ^ 1L, height - {band}), {band})")
    high = F.expr(f"shiftright(shiftleft((idx ^ 1L) + 1, height - {band}) - 1, {band})")
    last = F.expr(f"shiftright(shiftleft(1L, greatest(levels - {band}, 0)) - 1, {band})")
    given = nodes.filter((F.col("height") >= band) & (F.col("height") < F.col("levels")))
    given = given.select("tree", "height", "idx", "digest", F.explode(F.sequence(low, F.least(high, last))).alias("share"))
    return want.join(given, ["tree", "height", "idx", "share"]).groupBy("tree", "cell").agg(
        F.collect_list(F.struct("height", "idx", "digest")).alias("fetched")
    )


class Partition:
    """One leaf partition with the nodes it fetched: shared interior nodes, and the proof of each of its leaves."""

    def __init__(self, leaves: list[str], cell: int, levels: int, fetched: list[dict], band: int):
        self.interior, self.cell = [leaves], cell
        while len(self.interior) <= min(band, levels):
            self.interior.append(next_level(self.interior[-1]))
        got = {(f["height"], f["idx"]): f["digest"] for f in fetched}
        self.above = [(cell >> (h - band), got.get((h, (cell >> (h - band)) ^ 1))) for h in range(band, levels)]
        self.root = self.climb(self.interior[-1][0], self.above)

    @staticmethod
    def climb(node: str, way: Sequence[tuple[int, str | None]]) -> str:
        for index, sibling in way:
            node = step(node, index, sibling)
        return node

    def below(self, i: int) -> list[tuple[int, str | None]]:
        """(index, sibling) at each level of leaf ``i`` that lies in the partition."""
        way = []
        for nodes in self.interior[:-1]:
            way.append((i, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
            i >>= 1
        return way


def _opened(leaves: pa.Table, nodes: pa.Table, band: int) -> tuple[pa.Table, Partition]:
    leaves = leaves.sort_by("place")
    fetched = nodes["fetched"][0].as_py() if nodes.num_rows else []
    return leaves, Partition(leaves["leaf"].to_pylist(), leaves["cell"][0].as_py(), leaves["levels"][0].as_py(), fetched, band)


def proofs(placed: DataFrame, name: str, band: int = BAND) -> DataFrame:
    """(name, leaf, root, way) of every leaf; ``way`` lists (index, sibling) from the leaf to the root."""

    def expand(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        leaves, part = _opened(leaves, nodes, band)
        ways = [[{"index": i, "sibling": s} for i, s in part.below(k) + part.above] for k in range(leaves.num_rows)]
        kind = pa.list_(pa.struct([("index", pa.int64()), ("sibling", pa.string())]))
        return pa.table({
            "name": leaves[name], "leaf": leaves["leaf"], "root": pa.array([part.root] * leaves.num_rows, pa.string()), "way": pa.array(ways, kind),
        })

    nodes = fetched_nodes(placed, upper_nodes(placed, band), band)
    spec = "name string, leaf string, root string, way array<struct<index: long, sibling: string>>"
    slim = placed.select("tree", "levels", "cell", "place", "leaf", name)
    return slim.groupBy("tree", "cell").cogroup(nodes.groupBy("tree", "cell")).applyInArrow(expand, spec)


def manifest(
    docs: DataFrame, leaf: Column, claimed: Column, group: str = "lang", key: str = "doc_id", band: int = BAND
) -> DataFrame:
    """One row for each input row: ``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``leaf`` is the digest that enters the trees. ``claimed`` is the digest of the row as it is found later: its proof's
    siblings are folded with it to ``folded_root``, and ``verified`` tells whether that is ``root``.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("tree"), F.col(key).alias("id"), leaf.alias("leaf"), claimed.alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = placed_leaves(materialize(rows, "merkle-rows"), ["id", "leaf", "row"], band)
    nodes = upper_nodes(placed, band)
    roots = nodes.filter(F.col("height") == F.col("levels")).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf"))
    top = proofs(placed_leaves(roots, ["name"], band), "name", band)
    top = materialize(top.select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "root", "way"), "merkle-top")

    # every leaf partition gets one row: what it fetched, and the way from its tree's root
    cells = placed.select(F.col("tree").alias("tree"), F.col("cell").alias("cell")).distinct()
    cells = join_lookup(cells.join(fetched_nodes(placed, nodes, band), ["tree", "cell"], "left"), top, ["tree"])

    def expand(leaves: pa.Table, cell: pa.Table) -> pa.Table:
        leaves, part = _opened(leaves, cell.filter(cell["fetched"].is_valid()), band)
        subroot, root = cell["subroot"][0].as_py(), cell["root"][0].as_py()
        tail = part.above + [(w["index"], w["sibling"]) for w in cell["way"][0].as_py()]
        shared = part.climb(part.interior[-1][0], tail)
        end = "".join(s for _, s in tail if s)
        digests, folded = [], []
        for i, (own, later) in enumerate(zip(part.interior[0], leaves["claimed"].to_pylist(), strict=True)):
            way = part.below(i)
            digests.append(H(*[s for _, s in way if s], end))
            folded.append(shared if later == own else part.climb(later, way + tail))
        n = leaves.num_rows
        return pa.table({
            "id": leaves["id"], "leaf": leaves["leaf"], "subroot": pa.array([subroot] * n), "root": pa.array([root] * n),
            "proof_sha256": pa.array(digests), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded]),
        })

    spec = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    slim = placed.select("tree", "levels", "cell", "place", "leaf", "claimed", "id")
    return slim.groupBy("tree", "cell").cogroup(cells.groupBy("tree", "cell")).applyInArrow(expand, spec)


def document_manifest(docs: DataFrame, band: int = BAND) -> DataFrame:
    """``manifest`` of a documents table; where 7 divides the CRC of its id, a row is found with ``n_chars`` one greater."""
    fields = {name: F.col(name) for name in FIELDS}
    greater = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = leaf_digest(list(fields.values()))
    claimed = F.when(tampered, leaf_digest(list({**fields, "n_chars": greater}.values()))).otherwise(leaf)
    return manifest(docs, leaf, claimed, band=band).withColumnRenamed("id", "doc_id")
