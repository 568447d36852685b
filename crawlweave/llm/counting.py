"""Exact counts of very many 64-bit hashes: packed lists from each task, summed by hash range.

A task sends each distinct hash once with its count, packed into one row for each hash range, so a hash that
is everywhere costs one entry for each task. Ranges are as many as the measured input needs for ``RANGE_BYTES``
of hashes each, so what one task gathers does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_SCHEMA = "bucket int, n int, hashes binary, counts binary"
RANGE_BYTES = 6 << 20
FLUSH = 1_200_000


def hash_ranges(docs: DataFrame, text: str = "text") -> int:
    """Number of hash ranges, from the bytes of all texts; a word has six bytes or so."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return max(8, int(size / 6 * 8 / RANGE_BYTES) + 1)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the zeros of small numbers compress."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpack(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(-1, n).T.copy().view(kind).ravel()


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences."""
    return _pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n, "<u8"), dtype=np.uint64) if n else np.empty(0, np.uint64)


def totals(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, with the sums of their counts."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first)


def lists(parts: Iterable[tuple[np.ndarray, np.ndarray]], ranges: int, most: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Rows of ``LIST_SCHEMA`` from (hashes, counts) pairs; at most about ``most`` hashes are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)

    def flush() -> pa.RecordBatch:
        hashes, counts = totals(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
        cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
        spans = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([b for b, _, _ in spans], pa.int32()), pa.array([hi - lo for _, lo, hi in spans], pa.int32()),
                pa.array([pack_sorted(hashes[lo:hi]) for _, lo, hi in spans], pa.binary()),
                pa.array([_pack(counts[lo:hi].astype("<u4")) for _, lo, hi in spans], pa.binary()),
            ],
            names=["bucket", "n", "hashes", "counts"],
        )

    for hashes, counts in parts:
        held.append((hashes, counts))
        size += len(hashes)
        if size >= most:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of one range, sorted, with their total counts."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n, h, c in zip(table["n"].to_pylist(), table["hashes"].to_pylist(), table["counts"].to_pylist(), strict=True):
        hashes.append(unpack_sorted(h, n))
        counts.append(_unpack(c, n, "<u4").astype(np.int64))
    return totals(np.concatenate(hashes), np.concatenate(counts))
