"""Language-model scores from a log-frequency Bloom filter.

Tokens are words (A-Z lower-cased, cut at ``[\\x20\\x09-\\x0D]``) and one end per text. Exact counts of all training
tokens and token pairs are gathered by hash range, and each range makes its part of the filter where its counts are. The
filter holds every n-gram, those seen once too: one of count c is entered at levels 1 to q, the last whose threshold is at
most c. Thresholds are exact up to ``EXACT`` and grow by ``STEP`` then. A reader probes for levels, which are
nested, by doubling and halving until it has the last one there, which bounds the count from both sides. Ranges are packed into broadcasts of about ``PART_BYTES``; a task asks each
for ``HOLD`` tokens at a time and has one in memory. So neither the scores nor the memory depend on the size of the corpus;
the number of broadcasts does.

p(w | v) = (1 - MIX) p(w) + MIX min(c(v w), c(v), c(w)) / (c(v) + e), p(w) = (c(w) + 1) / (N + V + 1), and p(w) alone after a
v that was never seen. Counts of w and v w are read from below and c(v) in the divisor from above, and e is more than the
followers that false positives may give a context (probes of the first level grow with the corpus, so e is small). So
what the model gives to all words after a context adds up to 1 at most.

The base score uses exact counts: the ``COMMON`` most frequent tokens are broadcast, all others are joined, so neither
a hot token nor the vocabulary meets one task.

Defined cases: null counts as empty, and an empty text is one end token. An empty training set gives every token the
count 0. Rows are scored one by one; repeated rows get equal scores. Only the id is carried besides the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm import counting
from crawlweave.llm.words import U64, give_back, mix, split_words, tidy
from crawlweave.session import materialize

MIX = 0.3
EXACT, STEP = 8, 1.2
MORE_PROBES = 12  # at the second level and further
PART_BYTES = 16 << 20
PIECE = 1 << 15
HOLD = 1_000_000
COMMON = 1_000_000
START, END = U64(0x5374617274000001), U64(0x456E640000000003)
TOP = U64(1 << 63)
SLICE = 200


def _thresholds() -> np.ndarray:
    found = list(range(1, EXACT + 1))
    while found[-1] < 1 << 61:
        found.append(max(found[-1] + 1, int(found[-1] * STEP)))
    return np.array(found, np.int64)


THRESHOLDS = _thresholds()
LOW = np.append(0, THRESHOLDS)  # by level, 0 for n-grams that are not in the filter
HIGH = np.append(0, np.append(THRESHOLDS[1:], 1 << 62) - 1)


@dataclass
class Tokens:
    hashes: np.ndarray  # words and ends of all texts; the top bit is 0
    first: np.ndarray  # tokens of text i are first[i]:first[i + 1]

    def pairs(self) -> np.ndarray:
        """Hash of each token with the one before it; the top bit is 1."""
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        before[self.first[:-1]] = START
        return mix(before * U64(0x9E3779B97F4A7C15) + self.hashes * U64(0xD6E8FEB86659FD93)) | TOP


def tokens_of(column: pa.Array) -> Tokens:
    words = split_words(column)
    h = np.insert(words.hashes(fold=True), words.first[1:], END) & ~TOP
    return Tokens(h, words.first + np.arange(len(words.first)))


def first_probes(tokens: float) -> int:
    """Probes of the first level: one more whenever the corpus doubles, so that false followers of a context stay few."""
    return max(8, int(np.ceil(np.log2(max(tokens, 1)))) - 12)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(THRESHOLDS, counts, "right")


def _pair_of_hashes(hashes: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of an n-gram's places at a level."""
    x = mix(hashes + np.asarray(level, U64) * U64(0xA24BAED4963EE407))
    return x, ((x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)) | U64(1)


def _place(x: np.ndarray, y: np.ndarray, probe: int, bits: np.ndarray | int) -> np.ndarray:
    return (((x + U64(probe) * y) >> U64(32)) * np.asarray(bits, U64)) >> U64(32)


def make_filter(hashes: np.ndarray, counts: np.ndarray, probes: int) -> tuple[int, bytes]:
    """Number of bits, about half of them set, and the bits."""
    level = levels(counts)
    many = len(hashes) * probes + int((level - 1).sum()) * MORE_PROBES
    size = int(many / np.log(2)) + 64
    bitmap = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        x, y = _pair_of_hashes(hashes[level >= q], q)
        for i in range(probes if q == 1 else MORE_PROBES):
            bitmap[_place(x, y, i, size)] = True
    return size, np.packbits(bitmap, bitorder="little").tobytes()


def gather_counts(training: DataFrame, ranges: int, probes: int, text: str = "text") -> DataFrame:
    """Per bucket of hashes: number, total, size and bits of its filter, and how many n-grams each level has.

    The lower half of the buckets holds tokens, with their hashes and counts; the upper half holds pairs.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for lo in range(0, batch.num_rows, SLICE):
                    t = tokens_of(batch.column(0).slice(lo, SLICE))
                    h, n = np.unique(np.concatenate([t.hashes, t.pairs()]), return_counts=True)
                    yield h, n.astype(np.int64)

        yield from counting.lists(parts(), ranges)

    def add(table: pa.Table) -> pa.Table:
        h, n = counting.gathered(table)
        size, bits = make_filter(h, n, probes)
        pairs = bool(len(h) and h[0] >= TOP)
        give_back()
        return pa.table({
            "bucket": table["bucket"].slice(0, 1), "pairs": pa.array([pairs]), "n": pa.array([len(h)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()),
            "size": pa.array([size], pa.int64()), "bits": pa.array([bits], pa.binary()), "levels": pa.array([np.bincount(levels(n)).tolist()], pa.list_(pa.int64())),
            "hashes": pa.array([None if pairs else counting.pack_sorted(h)], pa.binary()), "counts": pa.array([None if pairs else n.tobytes()], pa.binary()),
        })

    sent = training.select(text).mapInArrow(tidy(send), counting.LIST_SCHEMA)
    return sent.groupBy("bucket").applyInArrow(
        add, "bucket int, pairs boolean, n long, total long, size long, bits binary, levels array<long>, hashes binary, counts binary"
    )


@dataclass
class Filter:
    """The filter of all buckets in broadcasts; ``where`` gives each bucket's broadcast, first bit and size."""

    edges: np.ndarray
    where: np.ndarray
    parts: list[Broadcast]
    probes: int

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 where it is missing."""
        keys, back = np.unique(hashes, return_inverse=True)  # in the order of the buckets, so that probes stay close together
        cuts = np.concatenate([[0], np.searchsorted(keys, self.edges), [len(keys)]])
        bucket = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        level, part = np.zeros(len(keys), np.int16), self.where[0, bucket]
        for k, shared in enumerate(self.parts):
            at = np.flatnonzero((part == k) & (self.where[2, bucket] > 0))
            if not len(at):
                continue
            data = shared.value
            for lo in range(0, len(at), PIECE):
                some = at[lo : lo + PIECE]
                level[some] = self._levels(data, keys[some], self.where[1, bucket[some]], self.where[2, bucket[some]].astype(U64))
            if len(self.parts) > 1:  # it stays in the executor's file and is read again when asked again
                del data
                vars(shared).pop("_value", None)
        return level[back]

    def _levels(self, data: np.ndarray, hashes: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Levels are nested, so they are searched by doubling, then by halving."""

        def has(at: np.ndarray, level: np.ndarray | int, probes: int) -> np.ndarray:
            x, y = _pair_of_hashes(hashes[at], level)
            n, start, here = size[at], first[at], np.arange(len(at))
            for i in range(probes):
                place = _place(x, y, i, n).astype(np.int64) + start
                ok = (data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                if not ok.all():
                    x, y, n, start, here = x[ok], y[ok], n[ok], start[ok], here[ok]
            out = np.zeros(len(at), bool)
            out[here] = True
            return out

        low = has(np.arange(len(hashes)), 1, self.probes).astype(np.int16)
        high, live, q = low + 1, np.flatnonzero(low), 2
        while len(live):
            ok = has(live, q, MORE_PROBES)
            high[live[~ok]] = q
            live = live[ok]
            low[live], q = q, 2 * q
        live = np.flatnonzero(high - low > 1)
        while len(live):
            middle = (low[live] + high[live]) // 2
            ok = has(live, middle, MORE_PROBES)
            low[live[ok]], high[live[~ok]] = middle[ok], middle[~ok]
            live = live[high[live] - low[live] > 1]
        return low


def share_filter(counts: DataFrame, ranges: int, probes: int) -> Filter:
    """Buckets packed into broadcasts, in order; the driver holds one broadcast at a time."""
    sc, parts, held, size = counts.sparkSession.sparkContext, [], [], 0
    where = np.zeros((3, ranges), np.int64)

    def close() -> None:
        parts.append(sc.broadcast(np.frombuffer(b"".join(held), np.uint8)))

    for row in counts.select("bucket", "size", "bits").orderBy("bucket").toLocalIterator():
        if held and size + len(row["bits"]) > PART_BYTES:
            close()
            held, size = [], 0
        where[:, row["bucket"]] = len(parts), 8 * size, row["size"]
        held.append(row["bits"])
        size += len(row["bits"])
    if held:
        close()
    return Filter((np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(U64), where, parts, probes)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1).to_pylist()[0]
            yield counting.unpack_sorted(one["hashes"], one["n"]), np.frombuffer(one["counts"], np.int64)


def spare_mass(distinct: int, probes: int) -> float:
    """More than the number of words that a context gets by false positives: their mean and three deviations."""
    false = distinct * 2.0**-probes
    return 1 + false + 3 * false**0.5


def smoothed(word: np.ndarray, pair: np.ndarray, before: np.ndarray, before_high: np.ndarray, mass: int, spare: float) -> np.ndarray:
    """p(w | v) from counts read from below (``word``, ``pair``, ``before``) and from above (``before_high``)."""
    alone = (word + 1) / mass
    return np.where(before_high > 0, (1 - MIX) * alone + MIX * np.minimum(np.minimum(pair, before), word) / (before_high + spare), alone)


def score_texts(docs: DataFrame, training: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs``."""
    spark = docs.sparkSession
    ranges = 2 * counting.hash_ranges(training, text)
    about = training.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / 6).first()[0]
    counts = materialize(gather_counts(training, ranges, first_probes(about), text), "ngram-counts")
    single = counts.filter("not pairs")
    facts = single.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("v")).first()
    total, distinct = int(facts["n"]), int(facts["v"])
    spread = single.select(F.posexplode("levels").alias("q", "k")).groupBy("q").agg(F.sum("k").alias("k"))
    cut, room = int(THRESHOLDS[-1]), COMMON
    for row in spread.filter("q > 0").orderBy(F.desc("q")).collect():  # at most one row a level
        room -= row["k"]
        if room < 0:
            break
        cut = int(LOW[row["q"]])

    def flat(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, n in _unpacked(batches):
                ok = (n >= low) & (n < high)
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(n[ok])], names=["hash", "c"])

        return single.select("n", "hashes", "counts").mapInArrow(tidy(run), "hash long, c long")

    common = flat(cut, 1 << 62).toArrow().sort_by("hash")
    known = (common["hash"].to_numpy().view(U64), common["c"].to_numpy())
    grams = share_filter(counts, ranges, first_probes(about))
    model = spark.sparkContext.broadcast(known)
    n_texts = training.count()
    spare = spare_mass(distinct, grams.probes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = model.value
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                t = tokens_of(part.column(1))
                one, back = np.unique(t.hashes, return_inverse=True)
                held.append((part.column(0), t, one, back))
                size += len(t.hashes)
                if len(grams.parts) == 1 or size >= HOLD:
                    yield from answer(held, names, sizes)
                    held, size = [], 0
        if held:
            yield from answer(held, names, sizes)

    def answer(held: list, names: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = grams.levels(np.concatenate([x for _, t, one, _ in held for x in (one, t.pairs())]))
        spot = 0
        for ids, t, one, back in held:
            about, both = found[spot : spot + len(one)], found[spot + len(one) : spot + len(one) + len(back)]
            spot += len(one) + len(back)
            exact = np.zeros(len(one), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, one), len(names) - 1)
                exact = np.where(names[at] == one, sizes[at], 0)
            q = about[back]
            before_low, before_high = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
            before_low[1:], before_high[1:] = LOW[q[:-1]], HIGH[q[:-1]]
            before_low[t.first[:-1]] = before_high[t.first[:-1]] = n_texts
            p = smoothed(LOW[q], LOW[both], before_low, before_high, total + distinct + 1, spare)
            own = exact[back]
            sums = [np.add.reduceat(x, t.first[:-1]) for x in (np.log10(p), np.log10(own + 1.0), (own > 0).astype(np.int64))]
            rare = np.flatnonzero(own == 0)
            cuts = np.searchsorted(rare, t.first)
            rest = t.hashes[rare].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(t.first)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]),
                 pa.array([rest[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())],
                names=["id", "n_tokens", "score", "logs", "n_common", "rare"],
            )

    kind = docs.schema[key].dataType.simpleString()
    spec = f"id {kind}, n_tokens long, score double, logs double, n_common long, rare binary"
    scored = docs.select(F.col(key).alias("id"), F.col(text).alias("_text")).mapInArrow(tidy(score), spec)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scores")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            times = np.array([len(x) // 8 for x in raw], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(raw)), times))), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["row", "hash"]
            )

    rare = scored.select("row", "rare").mapInArrow(tidy(tokens), "row long, hash long").join(flat(1, cut), "hash")
    more = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("n_rare"))
    size = F.lit(float(np.log10(total + distinct + 1)))
    return scored.drop("rare").join(more, "row", "left").select(
        "id", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"), "score",
    )
