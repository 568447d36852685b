"""Language identification by compression.

Each language's dictionary is raw text of a bounded sample of labelled rows: the ``SAMPLE_ROWS`` rows whose
hashed id is lowest, a piece of at most ``PIECE_BYTES`` from the middle of each, ``DICT_BYTES`` in all. Dictionaries
may differ in size, as languages do in labelled text. What each saves on a byte of other languages' pieces, for its
size or as a relative, is measured on ``OTHERS`` of them or so and added to its outputs again. A text is reduced to its distinct words, lower-cased and without other signs, and all of that is compressed with
every dictionary, ``CHUNK_BYTES`` at a time so that a long text's own repeats don't drown the dictionary. The
language of the smallest output is the answer. The score is the share by which the second smallest is
larger, 0 below half a byte; a text is rejected when that is below ``MARGIN``. Answers closer than ``CLOSE`` are given anew at a
slower compression level; what is equal there goes to the alphabetically first language.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected. Empty label
tables give ``und`` for every text. With one language only, its score is 1. Rows are judged one by one, so
repeated rows get equal answers; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.llm.columns import packed
from crawlweave.llm.words import tidy

SAMPLE_ROWS = 512
PIECE_BYTES = 1_024
DICT_BYTES = 131_072
CHUNK_BYTES = 2_048
OTHERS = 512
MARGIN = 0.002
CLOSE = 0.03
LEVELS = (3, 12)
UNKNOWN = "und"


def letters(text: F.Column) -> F.Column:
    """Distinct lower-case words of a text, joined by spaces; empty if it has no letter."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), " ", -1)
    return F.array_join(F.array_distinct(words), " ")


class Dictionaries(dict):
    """Language -> raw dictionary. ``saved``: level by level, language -> bytes saved on a byte of other languages' text."""

    saved: tuple[dict[str, float], ...] = ()


def learn_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Dictionaries:
    """Language -> raw dictionary. At most ``SAMPLE_ROWS`` short pieces of a language reach the driver."""
    at = F.greatest((F.length(text) - PIECE_BYTES) / 2, F.lit(0)).cast("int") + 1
    middle = F.substring(F.col(text), at, F.lit(PIECE_BYTES))
    # a middle without a letter says nothing; then the piece begins at the text's first letter
    piece = F.when(middle.rlike(r"\p{L}"), middle).otherwise(F.substring(F.regexp_replace(text, r"^[^\p{L}]+", ""), 1, PIECE_BYTES))
    rows = docs.filter(F.col(lang).isNotNull() & F.coalesce(text, F.lit("")).rlike(r"\p{L}"))
    order = Window.partitionBy("_lang").orderBy("_hash", "_piece")
    chosen = (
        rows.select(F.col(lang).alias("_lang"), F.xxhash64(key).alias("_hash"), piece.alias("_piece"))
        .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= SAMPLE_ROWS)
    )
    pieces: dict[str, list[str]] = {}
    for row in chosen.select("_lang", "_n", letters(F.col("_piece")).alias("_piece")).sort("_lang", "_n").collect():
        pieces.setdefault(row["_lang"], []).append(row["_piece"])
    words = {name: " ".join(dict.fromkeys(" ".join(found).split(" "))).encode() for name, found in sorted(pieces.items())}
    known = Dictionaries({name: content[-DICT_BYTES:] for name, content in words.items()})
    each = -(-OTHERS // max(1, len(pieces)))
    known.saved = saved_on_others(known, {name: [x.encode() for x in found[:each]] for name, found in pieces.items()})
    return known


def compressor(level: int, content: bytes = b"") -> zstandard.ZstdCompressor:
    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(level=level, **bare)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, **bare)


def saved_on_others(dictionaries: dict[str, bytes], pieces: dict[str, list[bytes]]) -> tuple[dict[str, float], ...]:
    """For each level and language, bytes saved on a byte of the other languages' pieces; next to 0 where those are few bytes."""
    out = []
    for level in LEVELS:
        plain = compressor(level)
        alone = {name: [len(plain.compress(x)) for x in found] for name, found in pieces.items()}
        saved = {}
        for name, content in dictionaries.items():
            own = compressor(level, content)
            others = [(x, n) for other, found in pieces.items() if other != name for x, n in zip(found, alone[other], strict=True)]
            saved[name] = sum(n - len(own.compress(x)) for x, n in others) / (PIECE_BYTES + sum(len(x) for x, _ in others))
        out.append(saved)
    return tuple(out)


class Judge:
    """Compressors of one process; made where they are used, because they cannot travel."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        saved = getattr(dictionaries, "saved", ()) or [{}] * len(LEVELS)
        self.levels = [[(compressor(level, dictionaries[n]), more.get(n, 0.0)) for n in self.names] for level, more in zip(LEVELS, saved, strict=True)]

    def judge(self, data: bytes) -> tuple[str, float]:
        if not data or not self.names:
            return UNKNOWN, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        for row in self.levels:
            sizes = [sum(len(c.compress(x)) for x in chunks) + more * len(data) for c, more in row]
            best = min(sizes)
            at = sizes.index(best)
            second = min(s for i, s in enumerate(sizes) if i != at)
            if second - best >= CLOSE * second:
                break
        return self.names[at], (second - best) / second if second - best >= 0.5 else 0.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default), then ``lang_pred``, ``lang_score`` and ``rejected``.

    The language of a narrow margin is still named; ``rejected`` says that it should not be relied on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each language
    wide = docs.select(letters(F.col(text)).cast("binary").alias("_letters"), packed(docs, keep).alias("row"))
    schema = T.StructType([
        wide.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            found = [judge.judge(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[0] == UNKNOWN or f[1] < MARGIN for f in found], pa.bool_())],
                names=["row", "lang_pred", "lang_score", "rejected"],
            )

    return wide.mapInArrow(tidy(run), schema)


def in_fold(key: str, folds: int, fold: int) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows whose language is clear, with the columns of the input."""
    return identify(docs, learn_dictionaries(docs, text, lang, key), text).filter(~F.col("rejected")).select("row.*")
