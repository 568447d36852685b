"""Sequential scans of ordered rows, spread over chunks.

Some operators replay events in order and cannot be written as sums (a token bucket, a
time-to-live). Rows are range-partitioned by key and order and sorted; each partition is a
chunk. A first pass describes every chunk by what it does to the state it is given, the
driver links those descriptions (one row per partition, never data), and a second pass
replays all chunks at once, each from its right start. One key may span any number of
chunks.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.operators.ordered import CHUNK
from crawlweave.session import cut_lineage


class Replay:
    """What an operator must say about a run of ticks of one key.

    ``t`` and ``n`` are arrays of tick times (microseconds) and event counts. States are
    integers; ``None`` is the state of a key never seen. ``effect`` describes a run so that
    ``apply`` can map a start state to an end state without the rows; ``apply`` returns
    ``NotImplemented`` when the description is not enough, which costs one extra scan.
    """

    def run(self, t: np.ndarray, n: np.ndarray, state) -> tuple[np.ndarray, object]:
        raise NotImplementedError

    def effect(self, t: np.ndarray, n: np.ndarray) -> dict:
        return {}

    def apply(self, effect: dict, state):
        return NotImplemented


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, str, np.ndarray, np.ndarray, bool]]]:
    """Per Arrow batch its runs of one key, in order: (chunk, key, t, n, first run of this key in the chunk)."""
    last = None
    for b in batches:
        if not len(b):
            continue
        key, t, n, chunk = (b[c].to_numpy() for c in ("key", "t", "n", CHUNK))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(b)]
        out = []
        for lo, hi in zip(cuts, cuts[1:]):
            out.append((int(chunk[lo]), key[lo], t[lo:hi], n[lo:hi], key[lo] != last))
            last = key[lo]
        yield out


SUMMARY = "chunk int, first_key string, last_key string, effect string, tail string"
OUT = "key string, t long, n long, passed long"


def _summary(op: Replay) -> Callable:
    def run(batches):
        chunk = first = last = tail = None
        head: list[tuple[np.ndarray, np.ndarray]] = []  # times and counts of the first key, one partition at most
        for chunk, key, t, n, fresh in itertools.chain.from_iterable(_runs(batches)):
            if first is None:
                first = key
            if key == first:
                head.append((t, n))
            else:
                tail = op.run(t, n, None if fresh else tail)[1]
            last = key
        if chunk is not None:
            effect = op.effect(*(np.concatenate(x) for x in zip(*head)))
            yield pd.DataFrame(
                [(chunk, first, last, json.dumps(effect), json.dumps(tail))],
                columns=["chunk", "first_key", "last_key", "effect", "tail"],
            )

    return run


def _replay(op: Replay, starts: dict[int, object]) -> Callable:
    def run(batches):
        state, begun = None, False
        for runs in _runs(batches):
            passed = []
            for chunk, _, t, n, fresh in runs:
                if not begun:
                    state, begun = starts.get(chunk), True
                elif fresh:
                    state = None
                done, state = op.run(t, n, state)
                passed.append(done)
            keys = np.repeat(np.array([r[1] for r in runs], dtype=object), [len(r[2]) for r in runs])
            yield pd.DataFrame({
                "key": keys, "t": np.concatenate([r[2] for r in runs]), "n": np.concatenate([r[3] for r in runs]),
                "passed": np.concatenate(passed),
            })

    return run


def _end_of(op: Replay, start: object) -> Callable:
    def run(batches):
        state = start
        for _, _, t, n, _ in itertools.chain.from_iterable(_runs(batches)):
            _, state = op.run(t, n, state)
        yield pd.DataFrame({"state": [json.dumps(state)]})

    return run


def replay_in_order(ticks: DataFrame, op: Replay) -> DataFrame:
    """(key, t, n) with one row per key and time, to (key, t, n, passed)."""
    chunks = cut_lineage(
        ticks.select(F.col("key").cast("string"), F.col("t").cast("long"), F.col("n").cast("long"))
        .repartitionByRange("key", "t")
        .sortWithinPartitions("key", "t")
        .withColumn(CHUNK, F.spark_partition_id())
    )
    rows = chunks.mapInPandas(_summary(op), SUMMARY).collect()  # one row per partition
    starts: dict[int, object] = {}
    prev_key = state = None
    for r in sorted(rows, key=lambda r: r["chunk"]):
        if r["first_key"] != prev_key:
            state = None
        starts[r["chunk"]] = state
        if r["last_key"] != r["first_key"]:
            state = json.loads(r["tail"])
        else:
            begin, state = state, op.apply(json.loads(r["effect"]), state)
            if state is NotImplemented:
                one = chunks.filter(F.col(CHUNK) == r["chunk"]).coalesce(1).sortWithinPartitions("key", "t")
                state = json.loads(one.mapInPandas(_end_of(op, begin), "state string").first()["state"])
        prev_key = r["last_key"]
    return chunks.mapInPandas(_replay(op, starts), OUT)
