"""Removal of repeated byte strings by distributed prefix doubling.

Texts are UTF-8 bytes. A window is ``window`` consecutive bytes of one text; every byte in a window that also starts earlier
goes. Positions get ranks that tell apart the strings which start there. Spark sorts pairs of ranks, of a position and of
the one an offset further, by range; equal pairs get one new rank for twice the length, a pair that occurs once drops out.
Offsets grow until the ranks cover a window; the last sort also finds where each string starts first.

Sorting every byte's position would move eight times the input in each round. So the first round ranks samples only: of the
positions with ``GRAM`` bytes left in a window, the one with the smallest hash of eight bytes stands for all windows that choose
it (their starts are one run), and equal windows choose the same position in themselves. Samples rank by their string and
by all that their windows cover:

* a sample that occurs with one surrounding only is settled: all its windows are first or all are repeats;
* of equal surroundings the first stays and the others go as a whole;
* where one sample has several surroundings, the windows of the first of each enter the doubling, from ``FIRST`` bytes on.

Texts are dealt once into cells of about ``CELL_BYTES`` by hashed id; the same exchange feeds every step that reads text.
A cell sends each distinct key once, packed by hash range, so a string that is everywhere costs one entry for each cell,
and ranges answer in the order of what was sent. Decisions travel with the answers. There is a message for each pair of a cell
and a range in each round, so ranges gather several cells' worth; what is decided already travels as one message that a
cell sends to itself, as intervals, and samples are found twice only: when they are sent and when they are answered.

Keys are 64-bit hashes that chain blocks through a non-linear mix (for surroundings with 48 bits of the sample's string; samples
that share those only enter the doubling); the pairs of later rounds are exact. Order: smaller id first, null ids last; then
the start, then the cell. Rows of one id are in one cell, ordered by text.

Defined cases: null is an empty text. Texts shorter than a window lose nothing. Of repeated rows the first stays. Empty
tables give empty results. Ids are integers. Only the id is carried, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.llm.counting import _pack, _unpack, pack_sorted, unpack_sorted
from crawlweave.llm.words import U64, give_back, mix

WINDOW = 100
GRAM = 48
FIRST = 50
CELL_BYTES = 16 << 20
RANGE_CELLS = 2  # one range gathers what so many cells send, or so
PIECE = 1 << 16
BATCH = 1 << 14
LAST = np.iinfo(np.int64).max
ONE, TWO = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
MESSAGE = "bucket int, cell int, step int, part int, n int, keys binary, second binary, ids binary, starts binary"
NAMES = ["bucket", "cell", "step", "part", "n", "keys", "second", "ids", "starts"]
KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
STATE = -1  # the step of what a cell sends to itself


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES)


def _mixed(h: np.ndarray, more: np.ndarray) -> None:
    """``mix`` of ``h`` with ``more``, in place of both."""
    h ^= more
    for factor in (U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)):
        np.right_shift(h, U64(33), out=more)
        h ^= more
        h *= factor
    np.right_shift(h, U64(33), out=more)
    h ^= more


def _narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on, in as many bytes as the largest takes."""
    most = int(values.max(initial=0))
    return values.astype("<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u8").astype(np.int64)


def _packed(low: np.ndarray) -> bytes:
    """Numbers that mostly ascend, as differences."""
    return _pack(np.diff(low, prepend=np.int64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, len(raw) // 8, "<i8")) if raw else np.empty(0, np.int64)


def _joined(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in order of ``lo``, with those that overlap as one."""
    if not len(lo):
        return lo, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] >= reach[:-1]]))
    return lo[new], reach[np.append(new[1:], len(lo)) - 1]


@dataclass
class Samples:
    """Per sample, in order of position: where its windows start (``lo`` to ``hi``), and its two names."""

    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    around: np.ndarray


class Cell:
    """The texts of a cell, in order, as one run of bytes."""

    def __init__(self, table: pa.Table, window: int):
        self.table = table.take(pc.sort_indices(table, [("id", "ascending"), ("text", "ascending")], null_placement="at_end"))
        text = pa.concat_arrays(self.table["text"].cast(pa.large_binary()).chunks or [pa.array([], pa.large_binary())])
        text = pc.fill_null(text, b"")
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
        size = int(offsets[-1] - offsets[0])
        padded = np.zeros(size + 8, np.uint8)
        if data is not None:
            padded[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        self.data = padded[:size]
        self.blocks = np.ndarray((size,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
        self.offsets, self.window = offsets - offsets[0], window
        self.number = table["cell"][0].as_py()

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id and start in the document of positions."""
        doc = np.searchsorted(self.offsets, at, "right") - 1
        ids = np.where(pc.is_null(self.table["id"]).to_numpy(), LAST, pc.fill_null(self.table["id"], 0).to_numpy().astype(np.int64))
        return ids[doc], at - self.offsets[doc]

    def words(self, at: np.ndarray, size: int) -> np.ndarray:
        """The ``size`` bytes, eight at most, from positions on."""
        return self.blocks[at] if size == 8 else self.blocks[at] & U64((1 << 8 * size) - 1)

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        """A hash of the ``size`` bytes from positions on; the last blocks overlap."""
        out = np.full(len(at), size, U64)
        step = min(size, 8)
        for lo in range(0, len(at), BATCH):
            piece = at[lo : lo + BATCH]
            for k in range(0, size, step):
                _mixed(out[lo : lo + BATCH], self.words(piece + min(k, size - step), step))
        return out

    def surroundings(self, lo: np.ndarray, end: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
        """A hash of all bytes from ``lo`` to ``end`` and of a place among them."""
        out = ((end - lo) << 32 | place).astype(U64)
        for i in range(0, len(lo), BATCH):
            first, final = lo[i : i + BATCH], end[i : i + BATCH] - step
            for k in range(0, int((final - first).max()) + step, step):
                _mixed(out[i : i + BATCH], self.words(np.minimum(first + k, final), step))
        return out

    def samples(self, gram: int) -> Samples:
        """Whole cell, in pieces of ``PIECE`` bytes. The smallest hash of the first bytes of a gram chooses."""
        window, per, size, step = self.window, self.window - gram + 1, len(self.data), min(gram, 8)
        fits = np.zeros(size + 1, np.int8)  # positions where a window fits into its text
        a, b = self.offsets[:-1], self.offsets[1:] - window + 1
        ok = b > a
        np.add.at(fits, a[ok], 1)
        np.add.at(fits, b[ok], -1)
        fits = np.cumsum(fits[:-1], dtype=np.int8) > 0
        low, mask = U64((1 << 20) - 1), U64((1 << 8 * step) - 1)
        number = np.arange(PIECE + per, dtype=U64)
        one, two = np.empty(PIECE + per, U64), np.empty(PIECE + per, U64)
        found: list[tuple] = [(np.empty(0, np.int64),) * 3]
        for base in range(0, max(size - window + 1, 0), PIECE):
            n = min(PIECE, size - window + 1 - base)
            here = fits[base : base + n]
            m = n + per - 1
            np.bitwise_and(self.blocks[base : base + m], mask, out=one[:m])
            one *= ONE
            np.right_shift(one, U64(32), out=two)
            one ^= two
            one *= TWO
            one &= ~low
            one |= number  # equal hashes: the first
            got = 1
            while got < per:
                more = min(got, per - got)
                m -= more
                np.minimum(one[:m], one[more : m + more], out=two[:m])
                one, two, got = two, one, got + more
            chosen = one[:n] & low
            new = np.ones(n, bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (here[1:] != here[:-1])
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], n)
            live = here[lo]
            lo, hi = lo[live], hi[live]
            found.append((lo + base, hi + base, chosen[lo].astype(np.int64) + base))
        lo, hi, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return Samples(lo, hi, self.names(at, gram) >> U64(16), self.surroundings(lo, hi + window - 1, at - lo, step))


def _distinct(a: np.ndarray, b: np.ndarray, name: np.ndarray, owner: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The first position of each key (a, b), by bucket and position, and where buckets begin.

    ``name`` is a hash of the key. Two keys whose names agree in the upper bits may both be listed more than once, which costs
    an entry and changes no result. ``owner`` has 48 bits, of which the bucket is made."""
    bits = U64((1 << max(1, len(a).bit_length())) - 1)
    order = np.sort((name & ~bits) | np.arange(len(a), dtype=U64)) & bits
    order = order.astype(np.int64)
    new = np.ones(len(a), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    first = np.zeros(len(a), bool)
    first[order[new]] = True
    sent = np.flatnonzero(first)
    bucket = ((owner[sent] * U64(ranges)) >> U64(48)).astype(np.uint16)
    by = np.argsort(bucket, kind="stable")
    return sent[by], np.searchsorted(bucket[by], np.arange(ranges + 1))


def _spans(cuts: np.ndarray):
    return ((k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if hi > lo)


def _first_rows(cell: Cell, step: int, a: np.ndarray, b: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> list[tuple]:
    """Messages that ask which of the keys are first; ids ascend with the positions."""
    ids, starts = cell.places(at)
    further = np.diff(ids, prepend=np.int64(0)).view(U64)
    upper, lower = (a >> U64(32)).astype("<u4"), (a & U64(0xFFFFFFFF)).astype("<u4")
    upper = upper.astype("<u2") if not len(a) or upper.max() < 1 << 16 else upper
    return [
        (k, cell.number, step, -1, hi - lo, lower[lo:hi].tobytes() + upper[lo:hi].tobytes(), b[lo:hi].tobytes(),
         ids[lo : lo + 1].tobytes() + _narrow(further[lo + 1 : hi]), _narrow(starts[lo:hi]))
        for k, lo, hi in _spans(cuts)
    ]


@dataclass
class Keys:
    """Distinct keys (a, b) in order of bucket, a, b; ``inverse`` leads to the positions they came from."""

    a: np.ndarray
    b: np.ndarray | None
    inverse: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray | None, ranges: int) -> Keys:
        """Without ``b``, ``a`` is a hash, whose upper bits are the bucket."""
        if b is None:
            order = np.argsort(a)
            bucket = ((a >> U64(32)) * U64(ranges)) >> U64(32)
        else:
            bucket = ((mix(a * ONE + b) >> U64(32)) * U64(ranges)) >> U64(32)
            order = np.lexsort((b, a, bucket))
        sa, sk = a[order], bucket[order]
        new = np.ones(len(a), bool)
        new[1:] = sa[1:] != sa[:-1]
        if b is not None:
            sb = b[order]
            new[1:] |= sb[1:] != sb[:-1]
            b = sb[new]
        inverse = np.empty(len(a), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return cls(sa[new], b, inverse, np.searchsorted(sk[new], np.arange(ranges + 1, dtype=U64)))

    def rows(self, cell: int, step: int) -> list[tuple]:
        return [
            (k, cell, step, -1, hi - lo, pack_sorted(self.a[lo:hi]), b"" if self.b is None else _pack(self.b[lo:hi]), b"", b"")
            for k, lo, hi in _spans(self.cuts)
        ]


def _given(answers: pa.Table) -> dict[int, list[tuple]]:
    """step -> what ranges answered, in their order, or what the cell sent to itself."""
    out: dict[int, list[tuple]] = {}
    answers = answers.take(pc.sort_indices(answers, [("step", "ascending"), ("part", "ascending")]))
    for row in zip(*(answers[x].to_pylist() for x in ("step", "part", "n", "keys", "second", "ids")), strict=True):
        out.setdefault(row[0], []).append(row[1:])
    return out


def _marks(given: dict[int, list[tuple]], step: int) -> np.ndarray:
    return np.frombuffer(b"".join(x[2] for x in given.get(step, [])), np.uint8)


def _state(cell: int, lo: np.ndarray, end: np.ndarray, more: np.ndarray) -> tuple:
    return (-1 - cell, cell, STATE, 0, 0, _packed(lo), _packed(end), _packed(more), b"")


def _own_state(given: dict[int, list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = given.get(STATE)
    return (_unpacked(got[0][2]), _unpacked(got[0][3]), _unpacked(got[0][4])) if got else (np.empty(0, np.int64),) * 3


def _lengths(window: int, first: int) -> list[int]:
    out = [first]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _sent_samples(cell: Cell, gram: int, ranges: int) -> tuple[Samples, np.ndarray, np.ndarray]:
    s = cell.samples(gram)
    return s, *_distinct(s.gram, s.around, s.around, s.gram, ranges)


def _settle(cell: Cell, marks: np.ndarray, gram: int, ranges: int) -> tuple[np.ndarray, ...]:
    """Windows of samples that repeat as a whole go, as intervals of bytes; those whose sample has other surroundings are open,
    as intervals of starts."""
    s, sent, _ = _sent_samples(cell, gram, ranges)
    gone = np.ones(len(s.lo), bool)  # those not sent repeat within the cell
    gone[sent] = (marks & 1).astype(bool)
    live = np.zeros(len(s.lo), bool)
    live[sent] = marks == 2
    return *_joined(s.lo[gone], s.hi[gone] + (cell.window - 1)), s.lo[live], s.hi[live]


def _open_starts(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    runs = hi - lo
    return np.repeat(lo - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))


def _ranked(cell: Cell, starts: np.ndarray, given: dict[int, list[tuple]], step: int, ranges: int, first: int) -> tuple[np.ndarray, ...]:
    """Positions and pairs of ranks that take part in a round, after the rounds that were answered."""
    lengths = _lengths(cell.window, first)
    parts = {0}
    for longer, length in zip(lengths[:0:-1], lengths[-2::-1], strict=True):
        parts |= {p + longer - length for p in parts}
    there = np.zeros(len(cell.data) + 1, bool)
    for p in parts:
        there[starts + p] = True
    at = np.flatnonzero(there)
    a, b = cell.names(at, first), None
    for r in range(1, step):
        keys = Keys.of(a, b, ranges)
        rank = np.concatenate([unpack_sorted(x[2], x[1]) for x in given[r]])[keys.inverse] if given.get(r) else np.empty(0, U64)
        # the last bit tells whether another cell has the string too; one that occurs once drops out
        often = (rank & U64(1)).astype(bool) | (np.bincount(keys.inverse)[keys.inverse] > 1 if len(at) else False)
        at, rank = at[often], rank[often] >> U64(1)
        further = lengths[r] - lengths[r - 1]
        ahead = np.searchsorted(at, at + further)
        ok = ahead < len(at)
        ok[ok] = at[ahead[ok]] == at[ok] + further
        at, a, b = at[ok], rank[ok], rank[ahead[ok]]
    return at, a, b


def _send_samples(table: pa.Table, ranges: int, window: int, gram: int) -> pa.Table:
    cell = Cell(table, window)
    s, sent, cuts = _sent_samples(cell, gram, ranges)
    rows = _first_rows(cell, 0, s.gram[sent], s.around[sent], s.lo[sent], cuts)
    out = _messages(rows)
    del cell, s, rows
    give_back(cycles=False)
    return out


def _send_ranks(table: pa.Table, answers: pa.Table, step: int, ranges: int, window: int, gram: int, first: int) -> pa.Table:
    if not table.num_rows:
        return _messages([])
    cell, last, given = Cell(table, window), len(_lengths(window, first)), _given(answers)
    if step == 1:
        lo, end, *runs = _settle(cell, _marks(given, 0), gram, ranges)
        more = np.stack(runs, 1).ravel()
    else:
        lo, end, more = _own_state(given)
    starts = _open_starts(more[::2], more[1::2])
    at, a, b = _ranked(cell, starts, given, step, ranges, first)
    if step < last:
        rows = Keys.of(a, b, ranges).rows(cell.number, step)
        for r in range(1, step):  # earlier answers, sent along so that the next step has them too
            rows += [(-1 - cell.number, cell.number, r, part, n, keys, b"", b"", b"") for part, n, keys, _, _ in given.get(r, [])]
    else:  # only windows take part in the last round; those not sent repeat within the cell
        is_start = np.zeros(len(cell.data) + 1, bool)
        is_start[starts] = True
        is_start = is_start[at]
        at, a = at[is_start], a[is_start]
        b = np.zeros_like(a) if b is None else b[is_start]
        name = mix(a * ONE + b)
        sent, cuts = _distinct(a, b, name, name >> U64(16), ranges)
        rows = _first_rows(cell, step, a[sent], b[sent], at[sent], cuts)
        again = np.ones(len(at), bool)
        again[sent] = False
        lo, end = np.concatenate([lo, at[again]]), np.concatenate([end, at[again] + window])
        order = np.argsort(lo, kind="stable")
        lo, end = _joined(lo[order], end[order])
        more = at[sent]
    rows.append(_state(cell.number, lo, end, more))
    out = _messages(rows)
    del cell, rows, given
    give_back(cycles=False)
    return out


def _answer_back(table: pa.Table, packed: list[bytes], ns: list[int]) -> pa.Table:
    step, bucket = table["step"][0].as_py(), table["bucket"][0].as_py()
    return _messages([(0, c, step, bucket, n, p, b"", b"", b"") for c, n, p in zip(table["cell"].to_pylist(), ns, packed, strict=True)])


def _later(a: np.ndarray, b: np.ndarray, ids: np.ndarray, starts: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Per key: bit 1, if the same (a, b) starts earlier; bit 2, if ``a`` has other ``b`` too."""
    out = np.zeros(len(a), np.uint8)
    order = np.argsort(a)
    same = a[order[1:]] == a[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(order):
        return out
    order = order[np.lexsort((b[order], a[order]))]
    sa, sb = a[order], b[order]
    new_a = np.concatenate([[True], sa[1:] != sa[:-1]])
    new = new_a | np.concatenate([[True], sb[1:] != sb[:-1]])
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    earliest = np.ones(len(order), bool)
    for x in (ids, starts, cells, np.arange(len(a))):
        value = np.where(earliest, x[order], LAST)
        earliest &= value == np.minimum.reduceat(value, begin)[group]
    of = np.cumsum(new_a) - 1
    out[order] = ~earliest + 2 * (np.bincount(of, weights=new) > 1)[of]
    return out


def _rank_range(table: pa.Table, last: int) -> pa.Table:
    """Sort the keys of one range and answer each cell; what is only passed on stays as it is."""
    if table["bucket"][0].as_py() < 0:
        return table
    step, ns = table["step"][0].as_py(), table["n"].to_pylist()
    edges = np.cumsum([0, *ns]).tolist()

    def read(name: str, get=lambda x, n: _unpack(x, n, "<u8")) -> np.ndarray:
        return np.concatenate([get(x, n) for x, n in zip(table[name].to_pylist(), ns, strict=True)])

    if step in (0, last):
        a = read("keys", lambda x, n: _wide(x[4 * n :], n).view(U64) << U64(32) | np.frombuffer(x, "<u4", n))
        b = np.frombuffer(b"".join(table["second"].to_pylist()), "<u8")
        ids = read("ids", lambda x, n: np.cumsum(np.append(np.frombuffer(x, "<i8", 1), _wide(x[8:], n - 1))))
        starts = read("starts", _wide)
        out = _later(a, b, ids, starts, np.repeat(table["cell"].to_numpy().astype(np.int64), ns))
        packed = [out[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
    else:
        a = read("keys", unpack_sorted)
        b = read("second") if step > 1 else None
        order = np.argsort(a) if b is None else np.lexsort((b, a))
        sa = a[order]
        same = np.zeros(len(a), bool)
        same[1:] = sa[1:] == sa[:-1]
        if b is not None:
            same[1:] &= b[order[1:]] == b[order[:-1]]
        shared = same.copy()
        shared[:-1] |= same[1:]
        # ranks follow the sorted pairs, so those of one cell ascend too
        out = np.empty(len(a), U64)
        out[order] = (((U64(table["bucket"][0].as_py()) << U64(32)) + np.cumsum(~same).astype(U64)) << U64(1)) | shared.astype(U64)
        packed = [pack_sorted(out[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
    answer = _answer_back(table, packed, ns)
    del out, packed
    give_back(cycles=False)
    return answer


def _clean(table: pa.Table, answers: pa.Table, last: int, window: int, with_bytes: bool, schema: pa.Schema) -> pa.Table:
    if not table.num_rows:
        return schema.empty_table()
    cell, given = Cell(table, window), _given(answers)
    lo, end, at = _own_state(given)
    at = at[(_marks(given, last) & 1).astype(bool)]
    lo, end = np.concatenate([lo, at]), np.concatenate([end, at + window])
    order = np.argsort(lo, kind="stable")
    lo, end = _joined(lo[order], end[order])
    doc = np.searchsorted(cell.offsets, lo, "right") - 1
    touch = np.zeros(len(lo), bool)  # goes on where the one before ends, in the same text
    touch[1:] = (lo[1:] == end[:-1]) & (doc[1:] == doc[:-1])
    rows = cell.table.num_rows
    n_removed = np.bincount(doc, weights=end - lo, minlength=rows).astype(np.int64)
    n_spans = np.bincount(doc, weights=~touch, minlength=rows).astype(np.int64)
    cuts = np.searchsorted(doc, np.arange(rows + 1)).tolist()
    raw, lows, ends = memoryview(cell.data), lo.tolist(), end.tolist()
    digests, texts = [], []
    for i, (a, b) in enumerate(zip(cell.offsets[:-1].tolist(), cell.offsets[1:].tolist(), strict=True)):
        digest, kept = hashlib.sha256(), []
        for k in range(cuts[i], cuts[i + 1]):
            kept.append(raw[a : lows[k]])
            a = ends[k]
        kept.append(raw[a:b])
        for x in kept:
            digest.update(x)
        digests.append(digest.hexdigest())
        texts.append(b"".join(kept) if with_bytes else None)
    columns = [cell.table["id"], pa.array(np.diff(cell.offsets), pa.int64()), pa.array(n_removed), pa.array(n_spans), pa.array(digests, pa.string())]
    out = pa.table(columns + [pa.array(texts, pa.binary())] * with_bytes, schema=schema)
    del cell, raw, given
    give_back(cycles=False)
    return out


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM, first: int = FIRST,
    with_bytes: bool = False, cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """One row for each input row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked, ``kept`` bytes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    # a small table has smaller cells and ranges, so that all cores have some
    count = int(max(size / cell_bytes, min(parts, 4 * size / cell_bytes))) + 1
    ranges = max(8, min(int(max(size / cell_bytes / RANGE_CELLS, min(parts, 8 * size / cell_bytes))) + 1, 60_000))
    spread = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key))
    cells = docs.select(F.pmod(spread, F.lit(count)).cast("int").alias("cell"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    cells = cells.repartition(max(parts, min(count // 4, 100_000)), "cell")
    last = len(_lengths(window, first))
    sent = cells.groupBy("cell").applyInArrow(lambda t: _send_samples(t, ranges, window, gram), MESSAGE)
    answers = sent.groupBy("bucket").applyInArrow(lambda t: _rank_range(t, last), MESSAGE)

    def sender(step: int):
        return lambda t, a: _send_ranks(t, a, step, ranges, window, gram, first)

    for step in range(1, last + 1):
        sent = cells.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(sender(step), MESSAGE)
        answers = sent.groupBy("bucket").applyInArrow(lambda t: _rank_range(t, last), MESSAGE)
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    out = pa.schema(fields + [("kept", pa.binary())] * with_bytes)
    spec = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return cells.groupBy("cell").cogroup(answers.groupBy("cell")).applyInArrow(
        lambda t, a: _clean(t, a, last, window, with_bytes, out), spec
    )
