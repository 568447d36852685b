"""Benchmark decontamination in DataFrame operations only.

Words are runs of digits, a-z and characters outside ASCII, after A-Z were lower-cased. Every ``size`` consecutive words of a benchmark
item are a window; an item with fewer words, but not none, is one window. The distinct windows form a
broadcast hash table; its key hashes four words of a window, so a probe costs no copy of the window. Every
window of every document is probed where the document was read, and each hit is verified word by word.
Only hits are shuffled, by document.

Defined cases: null or wordless texts have no words and are clean. Wordless items have no window. An item
without an id can hit words but is not listed. Repeated document rows each get their own full counts.
Empty tables give empty results or clean documents. Columns of the input keep their names and values.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.llm.columns import packed
from crawlweave.session import materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, once A-Z are lower-cased
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
BROADCAST_WINDOWS = 4_000_000  # about 1 GB of windows at most; larger sets are joined by shuffle
BROADCAST_DOCS = 1_000_000  # 16 bytes each; more contaminated documents are joined by shuffle


def fold(text: Column) -> Column:
    """A-Z lower-cased; the quick function serves texts that are ASCII throughout."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _spaced(text: Column, between: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), between, " "))


def word_list(text: Column, lower: bool = True) -> Column:
    """Words in order; ``['']`` when there are none, which no window equals."""
    return F.split(_spaced(fold(text), NOT_WORD) if lower else _spaced(text, NOT_WORD_ANY_CASE), " ", -1)


def word_count(text: Column) -> Column:
    spaced = _spaced(text, NOT_WORD_ANY_CASE)
    return F.when(spaced == "", F.lit(0)).otherwise(
        F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def probe_key(words: Column, start: Column, size: int) -> Column:
    """Hash of four words spread over the window that starts at the 0-based place ``start``."""
    places = sorted({0, size // 3, 2 * size // 3, size - 1})
    return F.xxhash64(*[F.get(words, start + p) for p in places], F.lit(size))


def item_windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items): each distinct window once, with the sorted ids of the items that hold it."""
    words = benchmark.select(F.col(item).cast("string").alias("_item"), word_list(F.col(text)).alias("_w")).filter(F.col("_w")[0] != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    each = words.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_w", i, size))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("_item")).alias("items"))


def find_hits(docs: DataFrame, windows: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """One row per document with a verified hit: ``_id``, ``_th`` (hash of its text), ``spans``, ``items``.

    ``spans`` are the distinct (start, words) of hit windows, at most one per word and window length.
    """
    facts = windows.agg(
        F.sort_array(F.collect_set(F.size("window"))).alias("lengths"), F.count(F.lit(1)).alias("n")
    ).first()
    lengths = facts["lengths"] or [size]
    own = F.lit(None)
    for n in lengths:
        own = F.when(F.size("window") == n, probe_key(F.col("window"), F.lit(0), n)).otherwise(own)
    table = windows.select(own.alias("_hash"), "window", "items")
    table = F.broadcast(table) if facts["n"] <= BROADCAST_WINDOWS else table
    words = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_th"), word_list(F.col(text)).alias("_w"))
    # the outer form, because the inner one makes Spark split each text a second time to look for empty lists
    places = words.select("_id", "_th", "_w", F.posexplode_outer("_w").alias("_pos", "_word"))
    keys = [probe_key(F.col("_w"), F.col("_pos"), n) for n in lengths]
    probes = places.select("_id", "_th", "_w", "_pos", keys[0].alias("_hash") if len(keys) == 1 else F.explode(F.array(*keys)).alias("_hash"))
    start = F.col("_pos") + 1
    hits = probes.join(table, "_hash").filter(F.slice("_w", start, F.size("window")) == F.col("window"))
    return (
        hits.select("_id", "_th", F.struct(start.alias("start"), F.size("window").alias("n")).alias("_span"), "items")
        .groupBy("_id", "_th")
        .agg(F.collect_set("_span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )


def hit_words(spans: Column) -> Column:
    """Distinct 1-based places of hit words."""
    places = F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))
    return F.array_distinct(F.flatten(places))


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text: str = "text", key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """Every input row as ``row``, with ``n_words``, ``n_hit``, ``items``, ``hit_places`` and ``contaminated``.

    Contaminated: at least a twentieth of the words, and not none, lie in a benchmark window.
    """
    hits = find_hits(docs, item_windows(benchmark, size), text, key, size).select(
        "_id", "_th", hit_words(F.col("spans")).alias("hit_places"), F.sort_array("items").alias("items")
    )
    rows = docs.select(
        packed(docs, carry).alias("row"), F.col(key).alias("_r_id"), F.xxhash64(text).alias("_r_th"),
        word_count(F.col(text)).alias("n_words"),
    )
    same = F.col("_r_id").eqNullSafe(F.col("_id")) & (F.col("_r_th") == F.col("_th"))
    n_hit = F.coalesce(F.size("hit_places"), F.lit(0)).cast("long")
    return rows.join(hits, same, "left").select(
        "row", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "hit_places",
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The clean rows, with the columns of the input.

    Only hits are shuffled: the contaminated ids with the hashes of their texts are written once, and the rows are
    filtered where they were read.
    """
    hits = find_hits(docs, item_windows(benchmark), text, key).select("_id", "_th", F.size(hit_words(F.col("spans"))).cast("long").alias("_hit"))
    hits = materialize(hits, "benchmark-hits")
    few = hits.count() <= BROADCAST_DOCS
    same = docs[key].eqNullSafe(hits["_id"]) & (F.xxhash64(docs[text]) == hits["_th"]) & (hits["_hit"] * 20 >= word_count(docs[text]))
    return docs.join(F.broadcast(hits) if few else hits, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows; texts with hits lose the hit words, their other words are joined by one space."""
    # the word list is a column used twice, so that it is made once for each text and not for each word
    found = contamination(docs, benchmark, None, text, key).withColumn("_raw", word_list(F.col(f"row.`{text}`"), lower=False))
    left = F.array_except(F.sequence(F.lit(1), F.size("_raw")), F.col("hit_places"))
    cleaned = F.when(F.col("n_hit") > 0, F.array_join(F.transform(left, lambda i: F.element_at("_raw", i)), " ")).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[cleaned.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
