"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the whole vocabulary resolves pre-tokens that are one token. Each level
of the hash keeps the keys that are alone at their place in a bit array and passes the others on; a key's
number is the count of set bits before its own. Tier two: other pre-tokens start as linked bytes, and a heap
gives the pair of lowest rank, leftmost first, until no neighbouring pair is a token.

The vocabulary is a file of at most ``VOCAB_BYTES``, read on the driver and broadcast. Texts are handled whole,
a few megabytes at a time, and each distinct pre-token of such a slice once.

Defined cases: null counts as empty; empty texts have no ids. A vocabulary must hold all single bytes, so
every text can be encoded and decodes to itself. Rows are coded one by one, so repeated rows agree; other
columns pass through whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.columns import packed
from crawlweave.llm.words import mix, tidy

VOCAB_BYTES = 64 << 20
SLICE_CHARS = 1 << 18
CACHED_MISSES = 60_000  # in each of two generations


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank. The file lies beside the driver, as tokenizer files do."""
    with open(path, "rb") as f:
        raw = f.read(VOCAB_BYTES + 1)
    if len(raw) > VOCAB_BYTES:
        raise ValueError(f"the vocabulary is over {VOCAB_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def _hashes(keys: Sequence[bytes]) -> np.ndarray:
    """64-bit hash of each key, eight bytes at a time over all keys at once."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    data = np.frombuffer(b"".join(keys) + bytes(8), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(keys) else np.empty(0, np.int64)
    h = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max()) if len(keys) else 0
    for at in range(0, longest, 8):
        live = order[: np.searchsorted(-sizes[order], -at, "left")]
        word = np.zeros(len(live), np.uint64)
        for k in range(min(8, longest - at)):
            ok = sizes[live] > at + k
            word[ok] |= data[starts[live[ok]] + at + k].astype(np.uint64) << np.uint64(8 * k)
        h[live] = mix(h[live] ^ word) + np.uint64(at)
    return h


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: value -> 0..n-1; -1 or a wrong number for others."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, before = values, 0
        while len(rest):
            size = int(len(rest) * 1.5) + 64
            places = self._place(rest, len(self.levels), size)
            alone = np.bincount(places, minlength=size) == 1
            rank = before + np.cumsum(alone) - alone
            self.levels.append((alone, rank.astype(np.int32)))
            before += int(alone.sum())
            rest = rest[~alone[places]]

    @staticmethod
    def _place(values: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(values ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), -1, np.int64)
        open_ = np.arange(len(values))
        for level, (alone, rank) in enumerate(self.levels):
            places = self._place(values[open_], level, len(alone))
            hit = alone[places]
            out[open_[hit]] = rank[places[hit]]
            open_ = open_[~hit]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        tokens = list(ranks)
        hashes = _hashes(tokens)
        if len(np.unique(hashes)) != len(tokens):
            raise ValueError("two tokens share a hash")
        self.table = PerfectHash(hashes)
        self.slots: list[bytes] = [b""] * len(tokens)
        self.ids = np.zeros(len(tokens), np.uint32)
        for slot, token in zip(self.table.find(hashes), tokens, strict=True):
            self.slots[slot], self.ids[slot] = token, ranks[token]
        by_id = sorted(tokens, key=ranks.__getitem__)
        self.known = np.array([ranks[t] for t in by_id], np.int64)
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.id_bytes = [int(i).to_bytes(4, "little") for i in self.ids]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of a pre-token that is no token itself, as little-endian 32-bit integers."""
        n, rank_of = len(piece), self.ranks.get
        span = n + 1
        end = list(range(1, n + 1))  # part at i covers piece[i:end[i]]
        back = list(range(-1, n))
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)] + [None]  # rank of the part at i with the next
        heap = [r * span + i for i, r in enumerate(pair) if r is not None]  # rank, then place
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i = divmod(pop(heap), span)
            if pair[i] != rank:
                continue  # one of the parts has changed since
            j = end[i]
            stop = end[i] = end[j]
            back[stop], pair[i], pair[j] = i, None, None
            if stop < n and (r := rank_of(piece[i : end[stop]])) is not None:
                pair[i] = r
                push(heap, r * span + i)
            k = back[i]
            if k >= 0:
                pair[k] = r = rank_of(piece[k:stop])
                if r is not None:
                    push(heap, r * span + k)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]].to_bytes(4, "little"))
            i = end[i]
        return b"".join(out)

    def missed(self, piece: bytes) -> bytes:
        """``merge`` with a bounded memory of recent pre-tokens."""
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.merge(piece)
            if len(self.young) >= CACHED_MISSES:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= SLICE_CHARS):
                chars += len(texts[hi])
                hi += 1
            out += self._encode(texts[lo:hi])
            lo = hi
        return out

    def _encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        pieces: list[str] = []
        ends = []
        for text in texts:
            pieces += self.pattern.findall(text)
            ends.append(len(pieces))
        if not pieces:
            return [np.empty(0, np.uint32) for _ in texts]
        codes, distinct = pd.factorize(np.array(pieces, dtype=object))
        keys = [p.encode() for p in distinct]
        slots = self.table.find(_hashes(keys)).tolist()
        parts = [
            self.id_bytes[slot] if slot >= 0 and self.slots[slot] == key else self.missed(key)
            for slot, key in zip(slots, keys, strict=True)
        ]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), "<u4")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        ids = flat[_ragged(starts[codes], sizes[codes])]
        cuts = np.concatenate([[0], np.cumsum(sizes[codes])])[np.array(ends)]
        return np.split(ids, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        at = np.searchsorted(self.known, ids)
        return self.bytes[_ragged(self.starts[at], self.sizes[at])].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def shared_codec(vocabulary: tuple[str, dict[bytes, int]], pattern: str) -> Codec:
    """One codec for each worker process, so that what a task has merged serves the next one."""
    key = (vocabulary[0], pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary[1], pattern)
    return _codecs[key]


def _named(path: str) -> tuple[str, dict[bytes, int]]:
    ranks = read_ranks(path)
    return hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), ranks


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... of all i, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: Sequence[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` (all by default) as ``row``, then ``token_ids`` (little-endian unsigned 32-bit
    integers, if ``with_ids``), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    shared = docs.sparkSession.sparkContext.broadcast(_named(vocabulary))
    wide = docs.select(F.col(text).alias("_text"), packed(docs, keep).alias("row"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.insert(0, T.StructField("token_ids", T.BinaryType()))
    schema = T.StructType([wide.schema["row"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(shared.value, pattern)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:  # texts and ids of a slice only are held at a time
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + 2 * SLICE_CHARS, "right")))
                ids = codec.encode([t or "" for t in batch.column(0).slice(lo, hi - lo).to_pylist()])
                raw = [x.astype("<u4").tobytes() for x in ids]
                columns = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                if with_ids:
                    columns.insert(0, pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), *columns], names=schema.fieldNames())
                lo = hi

    return wide.mapInArrow(tidy(run), schema)


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """Columns of the input as ``row``, and the decoded text; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_named(vocabulary))
    wide = encoded.select(F.col(ids).alias("_ids"), packed(encoded).alias("row"))
    schema = T.StructType([wide.schema["row"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(shared.value, r"\s\S")
        for batch in batches:
            texts = [None if x is None else codec.decode(np.frombuffer(x, "<u4")).decode(errors="replace") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["row", out])

    return wide.mapInArrow(run, schema)
