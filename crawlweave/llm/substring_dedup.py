"""Removal of repeated passages by fixed-block anchors.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``. Each text is an anchor index and a probe at once: its
non-overlapping blocks of ``BLOCK`` words are indexed, and every rolling window of ``BLOCK`` words probes them. Any
``window`` consecutive words hold a whole block, so a passage that occurs twice shows as repeated blocks in both
places. Hits are extended to maximal exact repeats: all windows whose blocks are hits are compared by two
hashes, 96 bits together, and the union of windows that also start earlier is what is removed.

Texts are dealt once into cells of about ``CELL_BYTES`` by hashed id. The same exchange feeds three steps: a cell
sends each distinct hash once, as packed lists by hash range; ranges answer with the cell's repeated
blocks; candidate windows go the same way, and the answer names those that start earlier in another
cell. A passage that is everywhere so costs one entry for each cell, and no task gathers a group of copies.

Order: smaller id first, null ids last; then the start, then the cell. Rows of one id are in one cell, ordered by
text. Defined cases: null texts have no words. Texts shorter than a window lose nothing. Of repeated rows the
first stays. Empty tables give empty results. Only the id is carried, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm.counting import _pack, _unpack, hash_ranges, pack_sorted, unpack_sorted
from crawlweave.llm.words import U64, Words, split_words, windows

WINDOW = 20
BLOCK = 10  # at most (WINDOW + 1) / 2, so that every window holds a whole block
CELL_BYTES = 8 << 20
ANCHOR_MASK = U64(0xFFFFFFFFFFFF0000)  # anchors only propose windows, so 48 bits are enough
LAST = np.iinfo(np.int64).max

_SENT = "bucket int, cell int, n int, hashes binary, marks binary"
_FOUND = "bucket int, cell int, n int, hashes binary, second binary, ids binary, starts binary"


def _cuts(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(U64)
    cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
    return ((b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo)


def _ordered(table: pa.Table) -> pa.Table:
    """Rows of a cell by id, nulls last, then text."""
    return table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")], null_placement="at_end"))


def _at_starts(words: Words, size: int) -> np.ndarray:
    """Whether ``size`` words from each word on lie in one text."""
    doc = words.doc()
    ok = np.zeros(len(doc), bool)
    if len(doc) >= size:
        ok[: len(doc) - size + 1] = doc[size - 1 :] == doc[: len(doc) - size + 1]
    return ok


def _block_hashes(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of rolling windows, their hashes, and which of them are blocks of the index."""
    at = np.flatnonzero(_at_starts(words, block))
    place = at - np.repeat(words.first[:-1], np.diff(words.first))[at] if len(at) else at
    return at, windows(words.hashes(), block)[at] & ANCHOR_MASK if len(at) else np.empty(0, U64), place % block == 0


def _window_hashes(words: Words, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and an independent 32-bit hash of the windows at ``starts``."""
    return windows(words.hashes(), window)[starts], (windows(words.hashes(seed=2), window, seed=2)[starts] >> U64(32)).astype(np.uint32)


def _send_blocks(table: pa.Table, ranges: int, block: int) -> pa.Table:
    words = split_words(table["text"])
    _, h, is_block = _block_hashes(words, block)
    order = np.argsort(h, kind="stable")
    h, is_block = h[order], is_block[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    twice = np.diff(np.append(first, len(h))) > 1
    marks = np.maximum.reduceat(is_block.astype(np.uint8), first) + 2 * twice.astype(np.uint8) if len(h) else np.empty(0, np.uint8)
    h, cell = h[first], table["cell"][0].as_py()
    rows = [(b, cell, hi - lo, pack_sorted(h[lo:hi]), marks[lo:hi].astype(np.uint8).tobytes()) for b, lo, hi in _cuts(h, ranges)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "cell", "n", "hashes", "marks"])


def _answers(cells: list[int], parts: list[np.ndarray], extra: list[bytes]) -> pa.Table:
    return pa.table({
        "cell": pa.array(cells, pa.int32()), "n": pa.array([len(p) for p in parts], pa.int32()),
        "hashes": pa.array([pack_sorted(p) for p in parts], pa.binary()), "second": pa.array(extra, pa.binary()),
    })


def _repeated_blocks(table: pa.Table) -> pa.Table:
    """Per cell: hashes of its blocks that occur elsewhere, in any place."""
    ns, cells = table["n"].to_pylist(), table["cell"].to_pylist()
    lists = [unpack_sorted(x, n) for x, n in zip(table["hashes"].to_pylist(), ns, strict=True)]
    marks = [np.frombuffer(m, np.uint8) for m in table["marks"].to_pylist()]
    h = np.concatenate(lists)
    source = np.repeat(np.arange(len(ns)), ns)
    order = np.argsort(h, kind="stable")
    h, source, mark = h[order], source[order], np.concatenate(marks)[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= same[1:].copy()
    hit = (mark & 1).astype(bool) & (same | (mark > 1))
    h, source = h[hit], source[hit]
    by = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[by], np.arange(len(ns) + 1))
    parts = [h[by[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    kept = [i for i, p in enumerate(parts) if len(p)]
    return _answers([cells[i] for i in kept], [parts[i] for i in kept], [b""] * len(kept))


def _joined_lists(table: pa.Table) -> np.ndarray:
    got = [unpack_sorted(x, n) for x, n in zip(table["hashes"].to_pylist(), table["n"].to_pylist(), strict=True)]
    return np.sort(np.concatenate(got)) if got else np.empty(0, U64)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _send_windows(table: pa.Table, hits: pa.Table, ranges: int, window: int, block: int) -> pa.Table:
    """The cell's distinct candidate windows with their first place."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ["bucket", "cell", "n", "hashes", "second", "ids", "starts"]
    rows: list[tuple] = []
    if table.num_rows and hits.num_rows:
        table = _ordered(table)
        words = split_words(table["text"])
        at, h, is_block = _block_hashes(words, block)
        good = np.zeros(len(words.starts) + 1, np.int64)  # blocks at each word that aren't hits, summed up
        bad = at[is_block & ~_member(h, _joined_lists(hits))]
        good[bad + 1] = 1
        bad_before = np.cumsum(good)
        starts = np.flatnonzero(_at_starts(words, window))
        # a block starting in [s, s + window - block] lies within the window at s
        starts = starts[bad_before[starts + window - block + 1] == bad_before[starts]]
        if len(starts):
            one, two = _window_hashes(words, window, starts)
            order = np.lexsort((np.arange(len(one)), two, one))
            one, two, starts = one[order], two[order], starts[order]
            first = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            one, two, starts = one[first], two[first], starts[first]
            doc = words.doc()[starts]
            ids = np.where(pc.is_null(table["id"]).to_numpy(), LAST, pc.fill_null(table["id"], 0).to_numpy().astype(np.int64))[doc]
            place = (starts - words.first[doc]).astype(np.int64)
            cell = table["cell"][0].as_py()
            rows = [
                (b, cell, hi - lo, pack_sorted(one[lo:hi]), two[lo:hi].tobytes(), _pack(ids[lo:hi]), _pack(place[lo:hi]))
                for b, lo, hi in _cuts(one, ranges)
            ]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def _started_elsewhere(table: pa.Table) -> pa.Table:
    """Per cell: windows whose first place lies in another cell."""
    ns, cells = table["n"].to_pylist(), np.array(table["cell"].to_pylist(), np.int64)
    one = np.concatenate([unpack_sorted(x, n) for x, n in zip(table["hashes"].to_pylist(), ns, strict=True)])
    two = np.frombuffer(b"".join(table["second"].to_pylist()), "<u4")
    ids = np.concatenate([_unpack(x, n, "<i8") for x, n in zip(table["ids"].to_pylist(), ns, strict=True)])
    place = np.concatenate([_unpack(x, n, "<i8") for x, n in zip(table["starts"].to_pylist(), ns, strict=True)])
    source = np.repeat(cells, ns)
    order = np.lexsort((source, place, ids, two, one))
    one, two, source = one[order], two[order], source[order]
    later = np.zeros(len(one), bool)
    later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    one, two, source = one[later], two[later], source[later]
    by = np.lexsort((two, one, source))
    one, two, source = one[by], two[by], source[by]
    names, edges = np.unique(source, return_index=True)
    spans = list(zip(edges, [*edges[1:], len(source)], strict=True)) if len(names) else []
    return _answers(names.tolist(), [one[a:b] for a, b in spans], [two[a:b].tobytes() for a, b in spans])


def _clean(table: pa.Table, foreign: pa.Table, window: int, with_text: bool, schema: pa.Schema) -> pa.Table:
    if not table.num_rows:
        return schema.empty_table()
    table = _ordered(table)
    words = split_words(table["text"])
    starts = np.flatnonzero(_at_starts(words, window))
    covered = np.zeros(len(words.starts) + 1, np.int64)
    if len(starts):
        one, two = _window_hashes(words, window, starts)
        order = np.lexsort((np.arange(len(one)), two, one))
        same = np.zeros(len(one), bool)
        same[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        gone = np.zeros(len(one), bool)
        gone[order[same]] = True
        if foreign.num_rows:
            mark = np.dtype([("one", U64), ("two", np.uint32)])
            known = np.empty(sum(foreign["n"].to_pylist()), mark)
            known["one"] = np.concatenate([unpack_sorted(x, n) for x, n in zip(foreign["hashes"].to_pylist(), foreign["n"].to_pylist(), strict=True)])
            known["two"] = np.frombuffer(b"".join(foreign["second"].to_pylist()), "<u4")
            maybe = np.flatnonzero(_member(one, np.sort(known["one"])))
            if len(maybe):
                both = np.empty(len(maybe), mark)
                both["one"], both["two"] = one[maybe], two[maybe]
                gone[maybe[np.isin(both.view("V12"), known.view("V12"))]] = True
        at = starts[gone]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    keep = np.cumsum(covered)[:-1] == 0
    first = words.first.tolist()
    n_words, n_removed, digests, texts = [], [], [], []
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
        left = keep[lo:hi]
        n_words.append(hi - lo)
        n_removed.append(hi - lo - int(left.sum()))
        kept = words.joined(i, left)
        digests.append(hashlib.sha256(kept).hexdigest())
        if with_text:
            texts.append(kept.decode())
    columns = [table["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
    return pa.table(columns + [pa.array(texts, pa.string())] * with_text, schema=schema)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row for each input row: ``id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept_text``."""
    block = (window + 1) // 2
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = hash_ranges(docs, text)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    count = int(size / CELL_BYTES) + 1
    spread = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    cells = docs.select(F.pmod(spread, F.lit(count)).cast("int").alias("cell"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cells = cells.repartition(parts, "cell")
    sent = cells.groupBy("cell").applyInArrow(lambda t: _send_blocks(t, ranges, block), _SENT)
    answer = "cell int, n int, hashes binary, second binary"
    hits = sent.groupBy("bucket").applyInArrow(_repeated_blocks, answer)
    found = cells.groupBy("cell").cogroup(hits.groupBy("cell")).applyInArrow(lambda t, h: _send_windows(t, h, ranges, window, block), _FOUND)
    foreign = found.groupBy("bucket").applyInArrow(_started_elsewhere, answer)
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    out = pa.schema(fields + [("kept_text", pa.string())] * with_text)
    spec = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return cells.groupBy("cell").cogroup(foreign.groupBy("cell")).applyInArrow(lambda t, f: _clean(t, f, window, with_text, out), spec)
