"""Prefix trie of conversations, summed up by depth bands.

Each distinct sequence of first turns is a node, from the root without turns; a conversation is a member of all nodes that
begin it. A node is named by a 128-bit hash of its turns: the exclusive or over its turns of hashes of (place, SHA-256 of role
and text), so the names of a long conversation are a running sum that spans many tasks; texts are not shuffled.

Depth-band rollup: a node explodes only to its ancestors within its band, ``band`` consecutive depths, where the values
are added up. The totals of the bands' top nodes are then completed on the tree of these top nodes alone, in the same
way, and each completed total is handed to the nodes of the band above it. So no row explodes to more than ``band`` + 1
others, and a trie of depth D takes log D rounds, not D.

Hot nodes: members, children and subtrees are counted with partial sums where the rows are. The ids of the members that
end at a node are sorted over all tasks and packed to pieces of text before they meet in a stream for the node's digest.

Defined cases: turns are ordered by number, null first, then by the digest of role and text; null role or text is empty.
Rows without a conversation id belong to no conversation. Repeated rows are turns of their own. An empty table has no
node. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.llm.merkle import encoded
from crawlweave.operators.skew import is_small, join_groups
from crawlweave.session import materialize

BAND = 8
HASHES = 4
PIECE = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def turns_of(talks: DataFrame) -> DataFrame:
    """(conv_id, nth, said, bytes): each conversation's turns numbered from 0, with a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = talks.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.sha2(F.concat(encoded(role), encoded(text)), 256).alias("said"), F.octet_length(text).cast("long").alias("bytes")
    )
    sort = ["conv_id", F.col("turn").asc_nulls_first(), "said"]
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "trie-turns").withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy("conv_id", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "_range", "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = join_groups(rows, runs, ["conv_id", "_range"], "_n")
    return placed.select("conv_id", (F.col("_before") + F.col("_at") - F.col("_first")).alias("nth"), "said", "bytes")


def rebuilt(talks: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, place, said, bytes, last) of rebuilt conversations; place 0 stands for the conversation itself.

    Conversation c takes the first h turns of conversation c - c % ``family``, then its own after its first h; h is the CRC
    of c modulo ``most``. ``last`` is the number of its turns.
    """
    turns = materialize(turns_of(talks), "trie-numbered")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    known = sizes.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    known = known.join(bases, "base", "left").select(
        "conv_id", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")
    )
    known = materialize(known, "trie-conversations")
    starts = turns.filter(F.col("nth") < most).select(F.col("conv_id").alias("base"), "nth", "said", "bytes")
    copied = known.join(starts, "base").filter(F.col("nth") < F.col("h")).select("conv_id", (F.col("nth") + 1).alias("place"), "said", "bytes", "last")
    own = join_groups(turns, known.select("conv_id", "n", "h", "taken", "last"), ["conv_id"], "n").filter(F.col("nth") >= F.col("h"))
    own = own.select("conv_id", (F.col("nth") - F.col("h") + F.col("taken") + 1).alias("place"), "said", "bytes", "last")
    top = known.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("said"), F.lit(0).cast("long").alias("bytes"), "last")
    return copied.unionByName(own).unionByName(top)


def _name(sums: list[Column], depth: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(",", *[s.cast("string") for s in sums], depth.cast("string")), 256), 1, 32)


def named_prefixes(rows: DataFrame) -> DataFrame:
    """Adds ``node`` and ``parent``, the names of the turns up to this one and of those before it."""
    terms = [F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(k), "place", "said")) for k in range(HASHES)]
    rows = rows.repartitionByRange("conv_id", "place").withColumn("_range", F.spark_partition_id())
    rows = materialize(rows.withColumns({f"_x{k}": t for k, t in enumerate(terms)}), "trie-rows")
    names = [f"_x{k}" for k in range(HASHES)]
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv_id", "_range").agg(*[F.bit_xor(x).alias(x) for x in names])
    # only a conversation that began in an earlier range needs its sum from there, so there is one row for each range at most
    carry = carry.select("conv_id", "_range", *[F.bit_xor(x).over(before).alias(f"_c{x}") for x in names]).filter(f"_c{names[0]} IS NOT NULL")
    run = Window.partitionBy("conv_id", "_range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumns({f"_r{x}": F.bit_xor(x).over(run) for x in names}).join(_broadcast_if_small(carry), ["conv_id", "_range"], "left")
    sums = [F.col(f"_r{x}").bitwiseXOR(F.coalesce(f"_c{x}", F.lit(0).cast("long"))) for x in names]
    earlier = [s.bitwiseXOR(F.col(x)) for s, x in zip(sums, names, strict=True)]
    return here.select(
        "conv_id", "place", "bytes", "last", _name(sums, F.col("place")).alias("node"),
        F.when(F.col("place") > 0, _name(earlier, F.col("place") - 1)).alias("parent"),
    )


def _paths(prefixes: DataFrame, band: int) -> DataFrame:
    """(node, depth, path): ``path`` leads from the top node of the band to the node; for a top node, from that of the band above.

    A top node closes its band above and opens the one below; windows hold at most ``band`` + 1 rows.
    """
    closes = F.ceil(F.col("place") / band).cast("long")
    groups = F.when(F.col("place") % band == 0, F.array(closes, closes + 1)).otherwise(F.array(closes))
    each = prefixes.select("conv_id", "place", "node", closes.alias("_own"), F.explode(groups).alias("_g"))
    order = Window.partitionBy("conv_id", "_g").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    found = each.withColumn("path", F.collect_list("node").over(order)).filter("_g = _own")
    return found.groupBy("node", F.col("place").alias("depth"), "path").agg(F.lit(0).alias("_")).drop("_")


def subtree_sums(prefixes: DataFrame, own: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """(node, *values): the values of ``own`` (node, *values) added up over each node's subtree."""
    paths = materialize(_paths(prefixes, band).join(own, "node"), "trie-paths")
    is_top = F.col("depth") % band == 0
    within = paths.select(F.explode(F.when(is_top, F.array("node")).otherwise(F.col("path"))).alias("node"), *values)
    sums = within.groupBy("node").agg(*[F.sum(v).alias(v) for v in values])
    if not paths.filter(F.col("depth") >= band).limit(1).count():
        return sums
    sums = materialize(sums, "trie-sums")
    tops = prefixes.filter(F.col("place") % band == 0).withColumn("place", (F.col("place") / band).cast("long"))
    own_tops = sums.join(paths.filter(is_top).select("node"), "node", "left_semi")
    done = subtree_sums(tops, own_tops, values, band)
    # a completed total goes to the nodes of the band above its top node
    above = paths.filter(is_top & (F.col("depth") > 0)).select("node", F.slice("path", 1, band).alias("path")).join(done, "node")
    handed = above.select(F.explode("path").alias("node"), *values)
    return sums.unionByName(handed).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the decimal ids of (node, conv_id) rows, ascending and comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["node", "first", "ids"])

        for batch in batches:
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (name != node or size >= PIECE):
                    yield piece()
                    held, size = [], 0
                if not held:
                    node, first = name, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    ordered = ends.select("node", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ordered.mapInArrow(pack, "node string, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node string, ends_sha256 string")


def prefix_trie(rows: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each node of conversations given as by ``rebuilt``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``; ``saved_tokens`` adds up (members - 1) times the bytes of the last text over the node's subtree.
    """
    prefixes = materialize(named_prefixes(rows), "trie-prefixes")
    nodes = prefixes.groupBy("node", F.col("place").alias("depth"), "parent", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = materialize(nodes, "trie-nodes")
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = materialize(nodes, "trie-nodes")
    own = nodes.select(
        "node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    sums = subtree_sums(prefixes.select("conv_id", "place", "node"), own, ["n_leaves", "saved_tokens"], band)
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    below = join_groups(nodes.filter(F.col("parent").isNotNull()), parents, ["parent"], "_kids").drop("_kids")
    root = nodes.filter(F.col("parent").isNull()).withColumn("parent_conv_id", F.lit(None).cast(rows.schema["conv_id"].dataType))
    ends = end_digests(prefixes.filter(F.col("place") == F.col("last")))
    return below.unionByName(root).join(sums, "node").join(ends, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
