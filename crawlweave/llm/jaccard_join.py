"""N-gram Jaccard join by grouped prefixes, and the classes of linked documents.

A document's set holds the hashes of its distinct ``size``-word shingles (A-Z lower-cased; a shorter document is one
shingle). Two documents link when |A & B| / |A | B| reaches the threshold.

1. Exact counts of all shingles give the ``FREQUENT`` most common ones; they come last, rarest first, in the order
   of every set. Any common order gives right results; this one keeps boilerplate and copies out of the prefixes.
2. Linked sets share a token of their prefixes, the first n - ceil(t n) + 1 tokens. Documents with equal sets are
   one set; sets with equal prefixes and size are one group, which is joined once however many members it has.
3. Group pairs that share a prefix token pass the size and position bounds, and sets the sketch bound: a parity sketch
   differs in no more bits than the sets differ in tokens, so a larger distance proves that there is no link.
4. Pairs of groups, and of members of a group, are expanded to pairs of sets and verified on the whole sets.

Steps 3 and 4 run several times. First all groups of a token are paired if they are few (three times ``NEIGHBOURS`` and one),
else every group with ``NEIGHBOURS`` others, which is linear and joins most of a large cluster of near copies. At these
crowded tokens it is paired again, in orders that differ from token to token, so a set meets other members of its
cluster at each. Only entries of crowded tokens travel with sketches, and only members of paired groups with wide ones.
Then all pairs are made there whose sets aren't in one class yet: the classes are those of all links, but a cluster's
pairs are not listed. Only ids and the sets of such pairs travel, no texts.

Defined cases: null and wordless texts have an empty set and link with nothing. Rows without an id join classes
but never name one; a class without any id is named null. Repeated rows share a class. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.llm import counting
from crawlweave.llm.words import U64, Words, split_words, tidy, windows
from crawlweave.operators.skew import join_groups
from crawlweave.session import materialize, small_batches

FREQUENT = 200_000
SKETCH_LONGS = 8
NEIGHBOURS = 8
MIXED_TURNS = 2
COUNT_MASK = U64(0xFFFFFFFFFF000000)  # counts only order the tokens, so 40 bits tell them apart well enough
HOT_SHARE = 2_000
HELD_SHINGLES = 300_000  # shingles are mostly distinct, so holding more of them in a task saves little
BATCH_ROWS = 1_000  # a batch of texts or sets is held by Spark and by a Python worker at once
BROADCAST_IDS = 1_000_000


def text_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted shingle hashes of each text."""
    words: Words = split_words(column)
    h = words.hashes(fold=True)
    full = windows(h, size)
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = hi - lo
        if n >= size:
            yield np.unique(full[lo : hi - size + 1])
        elif n:
            yield windows(h[lo:hi], n, seed=n + 1)
        else:
            yield np.empty(0, U64)


def frequent_shingles(docs: DataFrame, size: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, rank) of the most common shingles; rank grows with the number of documents."""
    ranges = counting.hash_ranges(docs, text)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for lo in range(0, batch.num_rows, 400):
                    found = list(text_sets(batch.column(0).slice(lo, 400), size))
                    h, n = np.unique(np.concatenate(found) & COUNT_MASK, return_counts=True)
                    yield h, n.astype(np.int64)

        yield from counting.lists(parts(), ranges, HELD_SHINGLES)

    def common(table: pa.Table) -> pa.Table:
        h, n = counting.gathered(table)
        often = n >= 3
        return pa.table({"hash": h[often].view(np.int64), "n": n[often]})

    counts = docs.select(text).mapInArrow(tidy(send), counting.LIST_SCHEMA).groupBy("bucket").applyInArrow(common, "hash long, n long")
    counts = materialize(counts, "shingle-counts")
    cut, room = 0, FREQUENT
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator():
        cut, room = row["n"], room - row["c"]
        if room < 0:
            cut += 1
            break
    top = counts.filter(F.col("n") >= cut).toArrow().sort_by([("n", "descending"), ("hash", "ascending")])
    h = top["hash"].to_numpy().view(U64)
    rank = np.arange(len(h), 0, -1, dtype=np.int64)
    order = np.argsort(h)
    return h[order], rank[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def describe_sets(docs: DataFrame, size: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id``, ``n``, ``digest`` of the set, ``prefix`` (8 bytes a token), ``grp`` and ``wide`` of each row.

    ``wide`` is a parity sketch with at least two bits for each token; ``_sketch`` folds it to a fixed size where groups meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                rows: list[tuple] = []
                for s in text_sets(part.column(1), size):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if not len(s):
                        rows.append((0, digest, b"", digest, None))
                        continue
                    order = np.zeros(len(s), np.int64)
                    if len(known):
                        coarse = s & COUNT_MASK
                        at = np.minimum(np.searchsorted(known, coarse), len(known) - 1)
                        order = np.where(known[at] == coarse, rank[at], 0)
                    prefix = s[np.argsort(order, kind="stable")[: prefix_length(len(s), percent)]].tobytes()
                    longs = SKETCH_LONGS
                    while 32 * longs < len(s):
                        longs *= 2
                    bits = np.bincount((s >> U64(20)).astype(np.int64) & (64 * longs - 1), minlength=64 * longs) & 1
                    wide = np.packbits(bits.astype(np.uint8)).view(np.int64)
                    group = hashlib.blake2b(len(s).to_bytes(8, "little") + prefix, digest_size=16).digest()
                    rows.append((len(s), digest, prefix, group, wide.tolist()))
                n, digest, prefix, group, wides = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.binary()),
                     pa.array(group, pa.binary()), pa.array(wides, pa.list_(pa.int64()))],
                    names=["id", "n", "digest", "prefix", "grp", "wide"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"id {kind}, n long, digest binary, prefix binary, grp binary, wide array<long>"
    return docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(tidy(run), schema)


def _prefix_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2_000):
            part = batch.slice(lo, 2_000)
            prefixes = part.column(2).to_pylist()
            sizes = np.array([len(p) // 8 for p in prefixes], np.int64)
            at = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = part.column(1).to_numpy()[at]
            left = n - place  # tokens of the set from this one on
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(prefixes), np.int64)), part.column(0).take(pa.array(at)), pa.array(n), pa.array(left)],
                names=["token", "gid", "n", "left"],
            )


def _sketch(wide: Column) -> Column:
    """A wide sketch folded to ``SKETCH_LONGS``; it differs in no more bits than the wide ones do."""
    parts = F.sequence(F.lit(0), (F.size(wide) / SKETCH_LONGS).cast("int") - 1)
    fold = lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(wide[k * SKETCH_LONGS + i]))
    return F.array(*[fold(i) for i in range(SKETCH_LONGS)])


def _bits_apart(a: str, b: str) -> Column:
    total = F.lit(0)
    for i in range(SKETCH_LONGS):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def _sizes_may_link(percent: int) -> Column:
    return F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent


def _may_link(percent: int) -> Column:
    """False only where sizes or sketches prove that the sets do not link; a null sketch proves nothing."""
    apart = F.coalesce(_bits_apart("a.sketch", "b.sketch"), F.lit(0))
    return _sizes_may_link(percent) & (apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent))


def _wide_may_link(percent: int) -> Column:
    """The sketch bound for pairs of sets with their wide sketches; the wider one is folded to the other's size."""
    a, b = F.col("a.wide"), F.col("b.wide")

    def fold(x: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))

    a, b = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    apart = F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, x: total + x)
    return apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _places_may_link(a: Column, b: Column, percent: int) -> Column:
    """The size and position bounds of two groups (gid, n, left) at a common token."""
    room = F.least(a["left"], b["left"])  # tokens that can be common from here on
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    return sizes & (room * (100 + percent) >= (a["n"] + b["n"]) * percent)


def _may_share(percent: int) -> Column:
    """The size, position and sketch bounds of two groups at a common token."""
    return _places_may_link(F.col("a"), F.col("b"), percent) & _may_link(percent)


def _uncrowded() -> int:
    """Most groups of a token that are all paired where they are counted.

    Three times the neighbours: tokens of ten or so groups, mostly met by chance, grow faster than the input.
    """
    return 3 * NEIGHBOURS + 1


def shared_entries(rows: DataFrame, percent: int) -> DataFrame:
    """(token, gid, n, left, c, near): prefix tokens that at least two groups have, and how many have them.

    ``near`` has the groups to pair with at a token that is not crowded; with the pairs made here, tokens are shuffled once
    and without sketches. Rows of equal sets are of one group, so groups are made from the rows and prefixes are shuffled once.
    """
    groups = rows.groupBy("grp").agg(F.first("gid").alias("gid"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    tokens = groups.select("gid", "n", "prefix").mapInArrow(tidy(_prefix_tokens), "token long, gid long, n long, left long")
    shared = tokens.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("c > 1")
    own, order = F.struct("gid", "n", "left"), Window.partitionBy("token").orderBy("n", "gid")
    before = F.array_compact(F.array(*[F.lag(own, k).over(order) for k in range(1, _uncrowded())]))
    near = F.filter(F.col("_before"), lambda x: (x["gid"] != F.col("gid")) & _places_may_link(F.col("_own"), x, percent))
    shared = shared.select("token", "gid", "n", "left", "c", own.alias("_own"), before.alias("_before"))
    return shared.select("token", "gid", "n", "left", "c", F.when(F.col("c") <= _uncrowded(), F.transform(near, lambda x: x["gid"])).alias("near"))


def _held(ids: DataFrame) -> DataFrame:
    """Distinct ids, written once; broadcast unless they are many, so that what they pick isn't shuffled before."""
    ids = materialize(ids.distinct(), "jaccard-ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _labelled(sets: DataFrame, known: DataFrame | None) -> DataFrame:
    """``sets`` with the ``label`` of their class; before any class is known, each is a class of its own."""
    if known is None:
        return sets.withColumn("label", F.col("digest"))
    return sets.join(known.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _expanded(pairs: DataFrame, sets: DataFrame, known: DataFrame | None, percent: int) -> DataFrame:
    """Group pairs (ga, gb) as pairs of member digests that may link and are not of one class.

    Only the members of these groups are shuffled, with their wide sketches, which prove all that the folded ones do.
    """
    pairs = materialize(pairs.select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb")).distinct(), "jaccard-pairs")
    picked = sets.join(_held(pairs.select(F.explode(F.array("ga", "gb")).alias("gid"))), "gid", "left_semi").select("gid", "digest", "n", "wide")
    member = _labelled(picked, known).select("gid", F.struct("digest", "n", "wide", "label").alias("m"))
    left, right = member.select(F.col("gid").alias("ga"), F.col("m").alias("a")), member.select(F.col("gid").alias("gb"), F.col("m").alias("b"))
    found = pairs.join(left, "ga").join(right, "gb").filter(_sizes_may_link(percent) & (F.col("a.label") != F.col("b.label")))
    # sets of up to five sixths the size differ by one doubling at most, so one fold is enough
    found = found.filter(_wide_may_link(percent))
    return found.select(F.least("a.digest", "b.digest").alias("a"), F.greatest("a.digest", "b.digest").alias("b")).distinct()


def _facts(sets: DataFrame) -> DataFrame:
    """Per group: the sketch and digest of its member if it has only one."""
    one = F.count(F.lit(1)) == 1
    return sets.select("gid", "digest", _sketch(F.col("wide")).alias("sketch")).groupBy("gid").agg(
        F.when(one, F.first("sketch")).alias("sketch"), F.when(one, F.first("digest")).alias("digest")
    )


def _named(facts: DataFrame, known: DataFrame | None) -> DataFrame:
    """(gid, sketch, label) of groups; those of several sets, and all before any class is known, have no label."""
    if known is None:
        return facts.select("gid", "sketch", F.lit(None).cast("long").alias("label"))
    names = _labelled(facts.filter("digest IS NOT NULL").select("gid", "digest"), known).select("gid", F.xxhash64("label").alias("label"))
    return facts.select("gid", "sketch").join(names, "gid", "left")


def _labels_differ() -> Column:
    """False only where both groups are of one class; groups of several sets have no label."""
    return F.col("a.label").isNull() | F.col("b.label").isNull() | (F.col("a.label") != F.col("b.label"))


def neighbour_pairs(crowded: DataFrame, facts: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Pairs (ga, gb) of groups of different classes that lie close together, or first, among the groups of a crowded token.

    Turn 0 orders the groups by size; later turns order those of each token by hashes of its own.
    """
    own = crowded.join(facts, "gid").select("token", F.struct("gid", "n", "left", "sketch", "label").alias("a"))
    by = [F.xxhash64("token", "a.gid", F.lit(turn))] if turn else [F.col("a.n")]
    order = Window.partitionBy("token").orderBy(*by, "a.gid")
    near = [F.lag("a", k).over(order) for k in range(1, NEIGHBOURS + 1)] + [F.first("a").over(order)]
    pairs = own.select("a", F.array(*near).alias("_near")).select("a", F.explode(F.array_distinct(F.array_compact("_near"))).alias("b"))
    pairs = pairs.filter((F.col("a.gid") != F.col("b.gid")) & _labels_differ() & _may_share(percent))
    return pairs.select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"))


def remaining_pairs(crowded: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """All pairs (ga, gb) of groups of different classes that may link at a crowded token."""
    own = crowded.join(facts, "gid")
    side = lambda name: own.select("token", F.struct("gid", "n", "left", "sketch", "label").alias(name))
    pairs = side("a").join(side("b"), "token").filter((F.col("a.gid") < F.col("b.gid")) & _labels_differ() & _may_share(percent))
    return pairs.select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"))


def pairs_inside(sets: DataFrame, known: DataFrame | None, percent: int) -> DataFrame:
    """All pairs of sets of one group, but different classes, that may link."""
    several = sets.groupBy("gid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gid")
    picked = sets.join(_held(several), "gid", "left_semi").select("gid", "digest", "n", "wide")
    within = _labelled(picked, known).select("gid", F.struct("digest", "n", "wide", "label").alias("m"))
    inside = within.withColumnRenamed("m", "a").join(within.withColumnRenamed("m", "b"), "gid").filter(
        (F.col("a.digest") < F.col("b.digest")) & (F.col("a.label") != F.col("b.label")) & _sizes_may_link(percent) & _wide_may_link(percent)
    )
    return inside.select("a.digest", F.col("b.digest").alias("other")).toDF("a", "b")


def verified_links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pairs of digests whose whole sets reach the threshold."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    ids = materialize(reps.join(wanted, "digest", "left_semi").select(F.col("rep").alias("id")).distinct(), "jaccard-ids")
    few = ids.count() <= BROADCAST_IDS
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    picked = source.join(F.broadcast(ids) if few else ids, F.col("_id").eqNullSafe(F.col("id")), "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                found = [s.tobytes() for s in text_sets(batch.column(0).slice(lo, 500), size)]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["digest", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
                same = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = picked.mapInArrow(tidy(run), "digest binary, tokens binary").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("tokens").alias("tokens"))
    needs = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("digest"))
    both = needs.join(sets, "digest").groupBy("a", "b").agg(
        F.first(F.when(F.col("digest") == F.col("a"), F.col("tokens")), True).alias("ta"),
        F.first(F.when(F.col("digest") == F.col("b"), F.col("tokens")), True).alias("tb"),
    )
    return both.mapInArrow(tidy(verify), "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge (a, b).

    In each round a node takes its smallest neighbour's neighbour, and the edges are drawn anew between what was taken, so
    they grow fewer fast. Each round is written to the shared folder, where a lost executor can reread it.
    """
    edges = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        step = materialize(step, "steps")
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = materialize(step.join(jump, "to").select("node", F.least("to", "further").alias("to")), "steps")
        labels = materialize(
            labels.join(step.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
        )
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), F.col("to").alias("_to")), end).withColumn(end, F.col("_to")).drop("_to")
        edges = materialize(edges.filter(F.col("a") != F.col("b")).distinct(), "links")
    return labels


def joined_classes(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of ``known`` classes after further links (a, b) between nodes, linked before or not."""
    name = known.withColumnsRenamed({"node": "was", "label": "now"})
    for end in ("a", "b"):
        links = links.join(name, F.col(end) == F.col("was"), "left").withColumn(end, F.coalesce("now", end)).select("a", "b")
    later = connected(links)
    moved = later.withColumnsRenamed({"node": "was", "label": "now"})
    old = known.join(moved, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    return materialize(old.unionByName(later.join(known.select("node"), "node", "left_anti")), "jaccard-classes")


def classes(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: ``id``, ``n`` (set size) and ``class_id``, the smallest id of its class."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        return _classes(docs, size, percent, text, key)


def _classes(docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    described = materialize(describe_sets(docs, size, percent, text, key), "jaccard-sets")
    full = described.filter("n > 0").withColumn("gid", F.xxhash64("grp"))
    entries = materialize(shared_entries(full, percent), "jaccard-entries")
    facts = [F.first(c).alias(c) for c in ("gid", "n", "wide")]
    sets = materialize(full.groupBy("digest").agg(*facts, F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "jaccard-members")
    reps = sets.select("digest", "rep", "copies")
    crowded = entries.filter(F.col("c") > _uncrowded()).select("token", "gid", "n", "left")
    groups = materialize(_facts(sets.join(_held(crowded.select("gid")), "gid", "left_semi")), "jaccard-groups")

    def links(pairs: DataFrame) -> DataFrame:
        return verified_links(docs, reps, pairs, size, percent, text, key)

    pairs = entries.select(F.col("gid").alias("ga"), F.explode("near").alias("gb")).unionByName(neighbour_pairs(crowded, _named(groups, None), percent))
    known = connected(links(materialize(_expanded(pairs, sets, None, percent), "jaccard-near")))
    for turn in range(1, MIXED_TURNS + 1):
        pairs = neighbour_pairs(crowded, _named(groups, known), percent, turn)
        known = joined_classes(known, links(materialize(_expanded(pairs, sets, known, percent), "jaccard-near")))
    rest = _expanded(remaining_pairs(crowded, _named(groups, known), percent), sets, known, percent)
    known = joined_classes(known, links(materialize(rest.unionByName(pairs_inside(sets, known, percent)), "jaccard-rest")))
    named = reps.join(known, F.col("digest") == F.col("node"), "left").select("digest", "rep", "copies", F.coalesce("label", "digest").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    final = named.join(least, "label").select("digest", "copies", "class_id")
    rows = described.select("id", "n", "digest")
    hot = max(described.count() // HOT_SHARE, 2)
    placed = join_groups(rows.filter("n > 0"), final, ["digest"], "copies", hot).select("id", "n", "class_id")
    return placed.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("class_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows whose id names their class, with the columns of the input; rows without an id stay."""
    gone = classes(docs, size, percent, text, key).filter(F.col("id") != F.col("class_id")).select(F.col("id").alias("_gone")).distinct()
    gone = materialize(gone, "jaccard-gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col(key) == F.col("_gone"), "left_anti")
