"""Readers for uploaded URL files: text, CSV, JSON, spreadsheets.

Every reader gives (file, pos, url), pos being the place inside the file, plus ``error``
where a file could not be read. Files of one folder are read by one job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions.text import parse_json
from crawlweave.functions.urls import is_valid_url, normalize_url
from crawlweave.operators.skew import join_lookup
from crawlweave.session import materialize
from crawlweave.sources.records import array_elements, csv_records, read_parts

LINE_BREAKS = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
DELIMITERS = (",", ";", "\t", "|")
CSV_RECORD_LIMIT = 131_072  # characters of a record of several lines; more is an unclosed quote
ROWS = "file string, pos struct<block:long,row:long,part:long,item:long>, url string, error string"


def _lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, block, row, line); (block, row) follow the file, wherever its splits were read."""
    return (
        spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.posexplode(F.split("value", LINE_BREAKS)).alias("part", "line"),
        )
        .withColumn("line", F.regexp_replace("line", f"^{K.WS}+|{K.WS}+$", ""))
    )


def _explode_urls(df: DataFrame, urls: Column) -> DataFrame:
    return df.select("file", "block", "row", "part", F.posexplode(urls).alias("i", "url")).select(
        "file",
        F.struct("block", "row", F.col("part").cast("long").alias("part"), F.col("i").cast("long").alias("item")).alias("pos"),
        "url",
        F.lit(None).cast("string").alias("error"),
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{K.WS}+|{K.WS}+$", "")


def _url_like(c: Column) -> Column:
    return F.contains(c, F.lit("http")) | F.contains(c, F.lit("."))


def read_url_text(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """Lines without blanks and comments; a line may hold several URLs. ``simple``: one per line."""
    lines = _lines(spark, path, ".txt").filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    c = F.col("line")
    if mode == "simple":
        return _explode_urls(lines, F.array(c))
    spaced = F.filter(F.split(c, K.WS + "+"), lambda x: F.contains(x, F.lit("http")))
    items = (
        F.when(F.contains(c, F.lit(",")), F.transform(F.split(c, ","), _strip))
        .when(F.contains(c, F.lit(" ")) & ~c.startswith("http"), spaced)
        .otherwise(F.array(c))
    )
    return _explode_urls(lines, items)


def _cells(line: Column, delimiter: str) -> Column:
    d = {"\t": r"\t", "|": r"\|"}.get(delimiter, delimiter)
    raw = F.regexp_extract_all(line, F.lit(rf'(?:^|{d})("[^"]*+(?:""[^"]*+)*+"|[^{d}]*)'), F.lit(1))
    return F.transform(raw, lambda x: _strip(F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))))


def read_url_csv(spark: SparkSession, path: str, mode: str = "full", delimiter: str | None = None) -> DataFrame:
    """Single column: its cell. Several columns: the first cell that looks like a URL.

    The delimiter is the most frequent candidate in a file's first line, and that line is a header when none of its cells
    looks like a URL. Quoted cells may hold delimiters and line breaks, and a record may cross file splits. A file whose
    quotes make a record of more than ``CSV_RECORD_LIMIT`` characters is read as lines of comma-separated URLs. ``simple``
    takes the first column.
    """
    lines = read_parts(spark, path, "*.csv")
    heads = lines.filter(_strip(F.col("line")) != "").groupBy("file").agg(F.min(F.struct("block", "row", "line")).alias("h"))
    counts = [F.regexp_count("h.line", F.lit({"|": r"\|"}.get(d, d))) for d in DELIMITERS]
    best = F.greatest(*counts)
    chosen = F.lit(delimiter) if delimiter else F.coalesce(
        *[F.when((n == best) & (n > 0), F.lit(d)) for d, n in zip(DELIMITERS, counts)], F.lit(",")
    )
    heads = materialize(heads.select("file", F.struct("h.block", "h.row").alias("h"), chosen.alias("delim")), "csv-heads")
    records = csv_records(join_lookup(lines, heads.select("file", "delim"), ["file"], "inner"), DELIMITERS, CSV_RECORD_LIMIT)
    joined = join_lookup(records.filter(_strip(F.col("text")) != ""), heads, ["file"], "inner")

    def cells(text: Column) -> Column:
        out = _cells(text, DELIMITERS[0])
        for d in DELIMITERS[1:]:
            out = F.when(F.col("delim") == d, _cells(text, d)).otherwise(out)
        return out

    plain = F.filter(F.transform(F.split("text", ","), _strip), lambda x: x != "")
    is_head = (F.col("h.block") == F.col("block")) & (F.col("h.row") == F.col("row"))
    rows = joined.withColumn("_c", F.when(F.col("broken"), plain).otherwise(cells(_strip(F.col("text")))))
    rows = rows.filter(F.col("broken") | ~(is_head & ~F.exists("_c", _url_like)))
    first = F.get(F.filter("_c", lambda x: (x != "") & _url_like(x)), F.lit(0))
    pick = F.get("_c", F.lit(0)) if mode == "simple" else F.when(F.size("_c") == 1, F.get("_c", F.lit(0))).otherwise(first)
    urls = F.when(F.col("broken") & F.lit(mode != "simple"), F.col("_c")).when(pick.isNotNull(), F.array(pick))
    return _explode_urls(rows.withColumn("part", F.lit(0)), urls)


def _text_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _first_key(v: Column) -> Column:
    return F.coalesce(*[F.nullif(_text_of(v, f"$.{k}"), F.lit("")) for k in K.URL_KEYS])


def _item_url(v: Column, simple: bool) -> Column:
    kind = F.schema_of_variant(v)
    obj = _text_of(v, "$.url") if simple else _first_key(v)
    return F.when(kind == "STRING", _text_of(v, "$")).when(kind.startswith("OBJECT"), obj)


def read_url_json(spark: SparkSession, path: str, mode: str = "full", glob: str = "*.json") -> DataFrame:
    """An array of strings or objects, or an object with URL lists or direct URL fields.

    Files are read as text between commas. An array's elements are put together from that by many tasks and parsed one by
    one; a file of another kind is one value and is put together as a whole, uploads being limited in size. A file that is
    not JSON gives one row with ``error`` and no URL; Spark reads no row from an empty file, so it gives none.
    """
    parts = read_parts(spark, path, glob, ",")
    heads = parts.groupBy("file").agg(F.min(F.struct("block", "row", F.substring("line", 1, 100).alias("line"))).alias("h"))
    heads = materialize(heads.select("file", F.col("h.line").rlike(r"^\s*\[").alias("is_array")), "json-heads")
    parts = join_lookup(parts, heads, ["file"], "inner")
    others = parts.filter(~F.col("is_array")).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "row", "line"))).alias("p"))
    others = others.select("file", F.array_join(F.transform("p", lambda x: x["line"]), ",").alias("value"))
    whole = _whole_json(others, mode == "simple")
    return whole.unionByName(_array_urls(parts.filter("is_array").drop("is_array"), mode == "simple"))


def _array_urls(fragments: DataFrame, simple: bool) -> DataFrame:
    found = array_elements(fragments).withColumn("v", parse_json(F.col("text")))
    bad = ~F.col("sound") | F.col("v").isNull()
    found = materialize(found.select("file", "block", "row", bad.alias("bad"), F.when(~bad, _item_url(F.col("v"), simple)).alias("url")), "json-elements")
    spoilt = found.groupBy("file").agg(F.max("bad").alias("spoilt")).filter("spoilt")
    zero = lambda n: F.lit(0).cast("long").alias(n)
    rows = join_lookup(found, spoilt, ["file"]).filter(F.col("spoilt").isNull() & F.col("url").isNotNull())
    rows = rows.select("file", F.struct("block", "row", zero("part"), zero("item")).alias("pos"), "url", F.lit(None).cast("string").alias("error"))
    errors = spoilt.select(
        "file", F.struct(*[zero(n) for n in ("block", "row", "part", "item")]).alias("pos"), F.lit(None).cast("string").alias("url"),
        F.lit("Invalid JSON format").alias("error"),
    )
    return rows.unionByName(errors)


def _whole_json(texts: DataFrame, simple: bool) -> DataFrame:
    files = texts.select("file", parse_json(F.col("value")).alias("v")).withColumn("kind", F.schema_of_variant("v"))
    none = F.array().cast("array<string>")

    def items(path_: str) -> Column:
        return F.coalesce(F.try_variant_get("v", path_, "array<variant>"), F.array().cast("array<variant>"))

    from_array = F.transform(items("$"), lambda x: _item_url(x, simple))
    nested = []
    for k in ("urls",) if simple else K.URL_LIST_KEYS:
        nested.append(F.transform(items(f"$.{k}"), lambda x: _item_url_nested(x)))
    from_lists = F.filter(F.concat(*nested), lambda x: x.isNotNull())
    direct = F.coalesce(
        F.concat(*[_direct(k) for k in K.URL_KEYS]), none
    )
    found = (
        F.when(F.col("kind").startswith("ARRAY"), from_array)
        .when(F.col("kind").startswith("OBJECT"), F.when((F.size(from_lists) > 0) | F.lit(simple), from_lists).otherwise(direct))
        .otherwise(none)
    )
    bad = F.col("v").isNull()
    out = F.when(bad, F.array(F.lit(None).cast("string"))).otherwise(F.filter(found, lambda x: x.isNotNull()))
    return files.select("file", bad.alias("bad"), F.posexplode(out).alias("i", "url")).select(
        "file",
        F.struct(*[F.lit(0).cast("long").alias(n) for n in ("block", "row", "part")], F.col("i").cast("long").alias("item")).alias("pos"),
        "url",
        F.when(F.col("bad"), "Invalid JSON format").alias("error"),
    )


def _item_url_nested(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", _text_of(v, "$")).when(kind.startswith("OBJECT"), _text_of(v, "$.url"))


def _direct(key: str) -> Column:
    """A direct field: text, or a list of values."""
    v = F.variant_get("v", f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    values = F.transform(
        F.coalesce(F.try_variant_get("v", f"$.{key}", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: _text_of(x, "$"),
    )
    return (
        F.when(kind == "STRING", F.array(F.nullif(_text_of(v, "$"), F.lit(""))))
        .when(kind.startswith("ARRAY"), values)
        .otherwise(F.array().cast("array<string>"))
    )


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_cells(content: bytes, skip_header: bool) -> Iterator[tuple[int, str]]:
    """(column, text) of every filled cell, sheet by sheet, column by column."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = book.namelist()
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in root.iter(f"{NS}si")]
    sheets = sorted(
        (n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: int("".join(filter(str.isdigit, n)) or 0)
    )
    for sheet in sheets:
        columns: dict[int, list[str]] = {}
        rows = list(ElementTree.fromstring(book.read(sheet)).iter(f"{NS}row"))
        for row in rows[1:] if skip_header else rows:
            for i, c in enumerate(row.iter(f"{NS}c")):
                letters = "".join(ch for ch in c.get("r", "") if ch.isalpha())
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                value = c.find(f"{NS}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                elif value is None:
                    continue
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text or ""
                columns.setdefault(col or i + 1, []).append(text.strip())
        for col in sorted(columns):
            for text in columns[col]:
                yield col, text


def read_url_excel(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """URL-like cells of every sheet, first occurrence only; the first row is the header.

    ``simple`` takes the first column of the first sheet as it is. A workbook is one
    compressed file and has to be opened whole; different files go to different tasks.
    """
    simple = mode == "simple"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["file"], b["content"]):
                rows: list[tuple] = []
                try:
                    cells = list(_sheet_cells(bytes(content), True))
                    if simple:
                        found = [x for c, x in cells if c == 1 and x]
                    else:
                        found = list(dict.fromkeys(x for _, x in cells if x and ("http" in x or "." in x)))
                    rows = [(file, {"block": 0, "row": 0, "part": 0, "item": i}, u, None) for i, u in enumerate(found)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
                    rows = [(file, {"block": 0, "row": 0, "part": 0, "item": 0}, None, f"Failed to process Excel file: {e}")]
                yield pd.DataFrame(rows, columns=["file", "pos", "url", "error"])

    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true")
        .load(path)
        .select(F.col("path").alias("file"), "content")
        .mapInPandas(run, ROWS)
    )


READERS = {".txt": read_url_text, ".csv": read_url_csv, ".json": read_url_json, ".xlsx": read_url_excel}


def read_urls(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """All supported files of a folder in one frame; other files give an error row."""
    out = None
    for reader in READERS.values():
        part = reader(spark, path, mode)
        out = part if out is None else out.unionByName(part)
    odd = list_files(spark, path).filter(~F.col("suffix").isin(*READERS))
    return out.unionByName(
        odd.select(
            "file",
            F.lit(None).cast("struct<block:long,row:long,part:long,item:long>").alias("pos"),
            F.lit(None).cast("string").alias("url"),
            F.concat(F.lit("Unsupported file format: "), F.col("suffix")).alias("error"),
        )
    )


def simple_urls(read: DataFrame) -> DataFrame:
    """The simple variant's rule: validate first, then normalize; copies stay."""
    return read.filter(is_valid_url(F.col("url"))).withColumn("url", normalize_url(F.col("url")))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, suffix, MIME type, bytes, time, and whether it may be uploaded. Contents are not read."""
    args: list[Column] = []
    for suffix, mime in K.MIME_TYPES.items():
        args += [F.lit(suffix), F.lit(mime)]
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(
            F.col("path").alias("file"),
            F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).alias("suffix"),
            F.col("length").alias("bytes"),
            "modificationTime",
        )
        .withColumn("mime", F.try_element_at(F.create_map(*args), F.col("suffix")))
        .withColumn(
            "accepted", F.col("suffix").isin(*K.UPLOAD_SUFFIXES) & (F.col("bytes") <= K.UPLOAD_MAX_BYTES)
        )
    )


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing plus URLs found and errors per file."""
    found = read_urls(spark, path).groupBy(F.regexp_replace("file", "^file:/+", "/").alias("file")).agg(
        F.count("url").alias("n_urls"), F.max("error").alias("error")
    )
    listing = list_files(spark, path).withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    return listing.join(found, "file", "left").withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
