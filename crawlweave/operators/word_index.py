"""Inverted index of words with positions, stored by term; word and phrase search read their terms' postings only.

A row holds the postings of one term in one block of ``BLOCK_DOCS`` document ids: the ids as offsets in the block, and each
document's positions. A frequent term so is many rows of bounded size, spread over tasks. Rows lie in buckets by the
term's hash, sorted by term, so a search prunes folders by bucket and row groups by term.

Postings are gathered twice: each task makes rows of the documents it reads, so a word's occurrence travels as one number,
and after the only shuffle the rows of a term and block, which then follow each other, become one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions import text as X
from crawlweave.llm.words import tidy

BLOCK_DOCS = 4_096
BUCKETS = 64
PART_BLOCKS = 64
SLICE_DOCS = 2_000
SLICE_WORDS = 2_000_000
NO_ID, NO_BLOCK = -1, np.iinfo(np.int64).min  # of rows without an id
SENT = "term string, block long, words int, offsets binary, positions binary"  # a number a word: int16, and uint16 or uint32
ROW = "term string, block long, offsets array<int>, positions array<array<int>>"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _new_rows(term: np.ndarray, block: np.ndarray) -> np.ndarray:
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    return new


def _binary(numbers: np.ndarray, rows: np.ndarray) -> pa.Array:
    ends = np.append(rows, len(numbers)) * numbers.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers.tobytes())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of terms and blocks of ``SLICE_DOCS`` documents (doc, words) each."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_DOCS):
            part = batch.slice(lo, SLICE_DOCS)
            words = part.column(1)
            sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            has_id = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            block = np.where(has_id, doc // BLOCK_DOCS, NO_BLOCK)
            offset = np.where(has_id, doc % BLOCK_DOCS, NO_ID)
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            at = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            by_doc = np.empty(part.num_rows, np.int64)  # rows in the order of their ids
            by_doc[np.lexsort((offset, block))] = np.arange(part.num_rows)
            order = np.argsort(term * part.num_rows + by_doc[row], kind="stable")
            row, term, at = row[order], term[order], at[order]
            if len(np.unique(doc[has_id])) + (not has_id.all()) < part.num_rows:  # rows that share an id
                order = np.lexsort((at, offset[row], block[row], term))
                row, term, at = row[order], term[order], at[order]
            block, offset = block[row], offset[row].astype("<i2")
            rows = np.flatnonzero(_new_rows(term, block))
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(term[rows])), pa.array(block[rows], mask=block[rows] == NO_BLOCK), pa.array(np.diff(np.append(rows, len(term))).astype(np.int32)),
                 _binary(offset, rows), _binary(at.astype("<u2" if at.max() < 1 << 16 else "<u4"), rows)],
                names=["term", "block", "words", "offsets", "positions"],
            )


def _runs(table: pa.Table) -> np.ndarray:
    """The number of each row's run of equal term and block."""
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.cumsum(_new_rows(term, table.column("block").fill_null(NO_BLOCK).to_numpy())) - 1


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each term and block from rows sorted by both; the last ones of a batch may go on in the next."""

    def merged(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        firsts = np.flatnonzero(np.diff(run, prepend=-1))
        before = np.cumsum(np.append(0, table.column("words").to_numpy().astype(np.int64)))
        lo = 0
        while lo < len(firsts):
            hi = max(lo + 1, int(np.searchsorted(before[firsts], before[firsts[lo]] + SLICE_WORDS)))
            start, end = int(firsts[lo]), int(firsts[hi]) if hi < len(firsts) else table.num_rows
            yield _merged_rows(table.slice(start, end - start), run[start:end] - run[start])
            lo = hi

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if table.num_rows:
            table = table.combine_chunks()
            run = _runs(table)
            whole = int(np.searchsorted(run, run[-1]))
            held = table.slice(whole)
            yield from merged(table.slice(0, whole), run[:whole])
    if held is not None:
        yield from merged(held, np.zeros(held.num_rows, np.int64))


def _merged_rows(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
    words = table.column("words").to_numpy()
    offset = np.frombuffer(b"".join(table.column("offsets").to_pylist()), "<i2")
    row = np.repeat(run, words)
    at = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(table.column("positions").to_pylist(), words.tolist(), strict=True)])
    order = np.lexsort((at, offset, row))
    row, offset, at = row[order], offset[order], at[order].astype(np.int32)
    rows, docs = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(_new_rows(row, offset))
    offsets = offset[docs].astype(np.int32)
    docs_of_row = pa.array(np.append(np.searchsorted(docs, rows), len(docs)).astype(np.int32))
    positions = pa.ListArray.from_arrays(pa.array(np.append(docs, len(row)).astype(np.int32)), pa.array(at))
    firsts = pa.array(np.flatnonzero(np.diff(run, prepend=-1)))
    term, block = (table.column(c).combine_chunks().take(firsts) for c in ("term", "block"))
    return pa.RecordBatch.from_arrays(
        [term, block, pa.ListArray.from_arrays(docs_of_row, pa.array(offsets, mask=offsets == NO_ID)), pa.ListArray.from_arrays(docs_of_row, positions)],
        names=["term", "block", "offsets", "positions"],
    )


def build_index(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Index of integer ids. With ``mode="append"`` documents with new ids are added."""
    words = docs.select(F.col(doc_id).cast("long").alias("doc"), X.tokens(F.col(text)).alias("words"))
    rows = words.mapInArrow(tidy(_gather), SENT).withColumn("bucket", _bucket(F.col("term"), buckets))
    # a bucket's terms of PART_BLOCKS blocks share a task, so tasks stay small and few files arise
    rows = rows.repartition("bucket", F.floor(F.col("block") / PART_BLOCKS)).sortWithinPartitions("bucket", "term", "block")
    rows = rows.drop("bucket").mapInArrow(tidy(_merge), ROW)
    rows = rows.select("*", F.size("offsets").alias("n_docs"), _bucket(F.col("term"), buckets).alias("bucket"))
    rows.sortWithinPartitions("bucket", "term", "block").write.mode(mode).partitionBy("bucket").parquet(path)
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}-settings")


def postings(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """(term, doc, positions) of the terms; folders of other buckets are not opened."""
    wanted = sorted({t.lower() for t in terms})
    buckets = spark.read.parquet(f"{path}-settings").first()[0]
    found = spark.createDataFrame([(t,) for t in wanted], "term string").select(_bucket(F.col("term"), buckets)).distinct().collect()
    rows = spark.read.parquet(path).filter(F.col("bucket").isin([r[0] for r in found]) & F.col("term").isin(wanted))
    each = rows.select("term", "block", F.explode(F.arrays_zip("offsets", "positions")).alias("p"))
    return each.select("term", (F.col("block") * BLOCK_DOCS + F.col("p.offsets")).alias("doc"), F.col("p.positions").alias("positions"))


def _places(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """Documents with all terms and the positions of each as ``p0``, ``p1``, ..."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    columns = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(wanted)]
    both = postings(spark, path, wanted).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), *columns)
    return both.filter(F.col("n") == len(wanted))


def search(spark: SparkSession, path: str, words: Sequence[str]) -> DataFrame:
    """(doc_id, hits) of documents with all ``words``, as ``operators.search.word_search`` gives them."""
    wanted = {w.lower() for w in words}
    hits = postings(spark, path, list(wanted)).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("positions")).alias("hits"))
    return hits.filter(F.col("n") == len(wanted)).select(F.col("doc").alias("doc_id"), "hits")


def _back(places: int):
    return lambda x: x - places


def phrase_search(spark: SparkSession, path: str, phrase: Sequence[str]) -> DataFrame:
    """(doc_id, hits) of documents with the words of ``phrase`` next to each other, by intersecting their positions."""
    words = [w.lower() for w in phrase]
    order = list(dict.fromkeys(words))
    starts = None
    for k, w in enumerate(words):
        here = F.transform(F.col(f"p{order.index(w)}"), _back(k))
        starts = here if starts is None else F.array_intersect(starts, here)
    found = _places(spark, path, words).select(F.col("doc").alias("doc_id"), F.size(starts).cast("long").alias("hits"))
    return found.filter("hits > 0")
