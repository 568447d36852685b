"""Records of quoted text that cross lines and file splits, for files that many tasks read.

Whether a line (or a fragment between commas) lies inside quotes depends on all text before it. So every line is described
by what it does to that state, whatever the state is; windows inside a file split carry the description for both start
states, and a prefix composition over the splits, one row each, then tells which of the two is real. Lines that are a
record by themselves stay where they are; only the lines of the others meet, and the pieces of a record that was cut
between two splits are joined with them. Texts are shuffled once, by split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlweave.operators.skew import join_lookup
from crawlweave.session import materialize


def _split():
    return W.partitionBy("file", "block").orderBy("row")


def _upto():
    return _split().rowsBetween(W.unboundedPreceding, 0)


def _by_file():
    return W.partitionBy("file").orderBy("block")


def _earlier():
    return _by_file().rowsBetween(W.unboundedPreceding, -1)


def read_parts(spark: SparkSession, path: str, glob: str, separator: str | None = None) -> DataFrame:
    """(file, block, row, line): text between separators; (block, row) follow the file wherever its splits were read."""
    reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if separator:
        reader = reader.option("lineSep", separator)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"),
    )


def _composed(df: DataFrame, end0: Column, end1: Column, window, order: str, names: tuple[str, str]) -> DataFrame:
    """The states after each row, if the window began in state 0 or in state 1.

    A row that ends in one state whatever came before forgets the past; the others keep or flip the state.
    """
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumns({"_a0": end0.cast("int"), "_a1": end1.cast("int")})
    df = df.withColumn("_flips", F.sum(((F.col("_a0") == 1) & (F.col("_a1") == 0)).cast("int")).over(upto))
    reset = F.when(F.col("_a0") == F.col("_a1"), F.struct(order, F.col("_a0").alias("v"), F.col("_flips").alias("f")))
    df = df.withColumn("_reset", F.max(reset).over(upto))
    after = lambda h: F.when(F.col("_reset").isNull(), (F.col("_flips") + h) % 2).otherwise((F.col("_reset.v") + F.col("_flips") - F.col("_reset.f")) % 2)
    return df.withColumns({names[0]: after(0).cast("int"), names[1]: after(1).cast("int")}).drop("_a0", "_a1", "_flips", "_reset")


def _by(state: Column, zero: str, one: str) -> Column:
    return F.when(state == 0, F.col(zero)).otherwise(F.col(one))


def opens_quote(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a line that begins outside (or inside) a quoted cell ends inside one."""
    d = {"\t": r"\t", "|": r"\|"}.get(delimiter, delimiter)
    to_close, cells = r'[^"]*+(?:""[^"]*+)*+', rf'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^{d}]*+|[^"{d}][^{d}]*+)?{d})*+'
    opened = rf'{cells}"{to_close}\z'
    if inside:
        return line.rlike(rf'^(?:{to_close}\z|{to_close}"[^{d}]*+{d}{opened})')
    return line.rlike(f"^{opened}")


def csv_records(lines: DataFrame, delimiters: tuple[str, ...], limit: int) -> DataFrame:
    """Lines (file, block, row, line, delim) as records (file, block, row, text, broken).

    A file with a record of several lines of more than ``limit`` characters, as an unclosed quote makes, is ``broken``: each of its
    lines is a record. A record stands where its first line does.
    """

    def end(inside: bool) -> Column:
        out = opens_quote(F.col("line"), delimiters[0], inside)
        for d in delimiters[1:]:
            out = F.when(F.col("delim") == d, opens_quote(F.col("line"), d, inside)).otherwise(out)
        return F.when(F.contains("line", F.lit('"')), out).otherwise(F.lit(inside))

    seen = _composed(lines, end(False), end(True), _split(), "row", ("e0", "e1"))
    seen = seen.withColumns({f"s{h}": F.lag(f"e{h}", 1, h).over(_split()) for h in (0, 1)})
    seen = seen.withColumns({f"f{h}": F.max(F.when(F.col(f"s{h}") == 0, F.col("row"))).over(_upto()) for h in (0, 1)})
    seen = materialize(seen, "csv-lines")
    splits = seen.groupBy("file", "block").agg(
        F.max_by(F.struct("e0", "e1"), "row").alias("e"), F.max("f0").alias("last0"), F.max("f1").alias("last1")
    )
    splits = _composed(splits, F.col("e.e0"), F.col("e.e1"), _by_file(), "block", ("x0", "x1"))
    splits = splits.withColumn("began", F.lag("x0", 1, 0).over(_by_file()))
    last = _by(F.col("began"), "last0", "last1")
    carried = F.last(F.when(last.isNotNull(), F.struct("block", last.alias("row"))), ignorenulls=True).over(_earlier())
    known = join_lookup(seen, splits.select("file", "block", "began", carried.alias("carried")), ["file", "block"])
    began = F.col("began")
    known = known.select(
        "file", "block", "row", "line", _by(began, "s0", "s1").alias("start"), _by(began, "e0", "e1").alias("end"),
        _by(began, "f0", "f1").alias("first"), "carried",
    )
    several = known.filter((F.col("start") == 1) | (F.col("end") == 1)).select(
        "file", F.coalesce(F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("row"))), "carried").alias("at"),
        F.struct("block", "row", "line").alias("part"),
    )
    sizes = several.groupBy("file", "at").agg(F.sum(F.length("part.line") + 1).alias("n"))
    broken = materialize(sizes.filter(F.col("n") > limit).select("file", F.lit(True).alias("broken")).distinct(), "csv-broken")
    whole = join_lookup(known, broken, ["file"]).filter(F.col("broken") | ((F.col("start") == 0) & (F.col("end") == 0)))
    joined = join_lookup(several, broken, ["file"]).filter(F.col("broken").isNull()).groupBy("file", "at").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select("file", "block", "row", F.col("line").alias("text"), F.coalesce("broken", F.lit(False)).alias("broken")).unionByName(
        joined.select("file", "at.block", "at.row", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"), F.lit(False).alias("broken"))
    )


def _brackets(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def array_elements(fragments: DataFrame) -> DataFrame:
    """Elements (file, block, row, text, sound) of files that are one JSON array each, from their text between commas.

    ``sound`` is false in some element of a file whose brackets and strings don't end where the file does.
    """
    clean = F.when(F.contains("line", F.lit("\\")), F.regexp_replace("line", r"(?s)\\.", "")).otherwise(F.col("line"))
    outside = lambda h: F.array_join(F.filter(F.split(F.col("_clean"), '"'), lambda _, i: i % 2 == h), "")
    some = F.col("_clean").rlike(r"[\[\]{}]")
    seen = fragments.withColumn("_clean", clean).withColumns({
        "_q": F.length("_clean") - F.length(F.replace("_clean", F.lit('"'), F.lit(""))),
        **{f"_d{h}": F.when(some, _brackets(outside(h))).otherwise(0) for h in (0, 1)},
    })
    seen = seen.withColumn("_n", F.sum("_q").over(_upto()))
    # for both start states h: inside a string or not, and how deep since the start of the split, before the fragment and after it
    before = lambda h: (F.col("_n") - F.col("_q") + h) % 2
    seen = seen.withColumns({f"_c{h}": F.when(before(h) == 0, F.col("_d0")).otherwise(F.col("_d1")) for h in (0, 1)})
    seen = seen.withColumns({f"_sum{h}": F.sum(f"_c{h}").over(_upto()) for h in (0, 1)})
    seen = seen.withColumns({f"b{h}": F.struct(before(h).alias("inside"), (F.col(f"_sum{h}") - F.col(f"_c{h}")).alias("depth")) for h in (0, 1)})
    seen = seen.withColumns({f"a{h}": F.lead(f"b{h}").over(_split()) for h in (0, 1)})
    seen = seen.withColumns({f"z{h}": F.struct(((F.col("_n") + h) % 2).alias("inside"), F.col(f"_sum{h}").alias("depth")) for h in (0, 1)})
    seen = materialize(seen.select("file", "block", "row", "line", "b0", "b1", "a0", "a1", "z0", "z1"), "json-fragments")

    splits = seen.groupBy("file", "block").agg(F.max_by(F.struct("z0", "z1"), "row").alias("z"), F.max("row").alias("end"))
    splits = splits.withColumn("inside", F.coalesce(F.sum("z.z0.inside").over(_earlier()), F.lit(0)) % 2)
    change = _by(F.col("inside"), "z.z0.depth", "z.z1.depth")
    splits = splits.withColumn("_change", change).withColumn("depth", F.coalesce(F.sum("_change").over(_earlier()), F.lit(0)))
    all_of = W.partitionBy("file")
    splits = splits.select(
        "file", "block", "inside", "depth", F.min(F.struct("block")).over(all_of).alias("head"), F.max(F.struct("block", "end")).over(all_of).alias("tail"),
        ((F.sum("_change").over(all_of) == 0) & (F.sum("z.z0.inside").over(all_of) % 2 == 0)).alias("closed"),
    )
    known = join_lookup(seen, splits, ["file", "block"])
    here, after = _by(F.col("inside"), "b0", "b1"), _by(F.col("inside"), "a0", "a1")
    known = known.select("file", "block", "row", "line", "depth", "tail", "closed", here.alias("here"), after.alias("after"), (F.col("block") == F.col("head.block")).alias("_near"))
    depth = F.col("depth") + F.col("here.depth")
    is_head = F.col("_near") & (depth == 0) & (F.lag("row").over(_split()).isNull())
    is_tail = (F.col("tail.block") == F.col("block")) & (F.col("tail.end") == F.col("row"))
    begins = lambda s: (s["inside"] == 0) & (F.col("depth") + s["depth"] == 1)
    known = known.withColumn("_head", is_head).select(
        "file", "block", "row", "line", F.col("_head").alias("head"), is_tail.alias("tail"),
        (F.col("_head") | begins(F.col("here"))).alias("begins"), (is_tail | F.coalesce(begins(F.col("after")), F.lit(False))).alias("ends"),
        (F.col("closed") & (F.col("_head") | (F.col("here.inside") == 1) | (depth > 0))).alias("sound"),
    )
    known = materialize(known, "json-fragments")
    single = known.filter("begins AND ends").select("file", "block", "row", F.col("line").alias("text"), "head", "tail", "sound")
    rest = known.filter("NOT (begins AND ends)").withColumn("first", F.max(F.when(F.col("begins"), F.col("row"))).over(_upto()))
    last = rest.groupBy("file", "block").agg(F.max("first").alias("last"))
    carry = last.select("file", "block", F.last(F.when(F.col("last").isNotNull(), F.struct("block", F.col("last").alias("row"))), ignorenulls=True).over(_earlier()).alias("carried"))
    rest = join_lookup(rest, carry, ["file", "block"]).select(
        "file", F.coalesce(F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("row"))), "carried", F.struct("block", "row")).alias("at"),
        F.struct("block", "row", "line").alias("part"), "head", "tail", "sound",
    )
    rest = rest.groupBy("file", "at").agg(
        F.sort_array(F.collect_list("part")).alias("parts"), F.max("head").alias("head"), F.max("tail").alias("tail"), F.min("sound").alias("sound")
    ).select("file", "at.block", "at.row", F.array_join(F.transform("parts", lambda p: p["line"]), ",").alias("text"), "head", "tail", "sound")
    found = single.unionByName(rest)
    text = F.when(F.col("head"), F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    found = found.withColumn("text", text).withColumn("text", F.when(F.col("tail"), F.regexp_replace("text", r"\]\s*\z", "")).otherwise(F.col("text")))
    empty = F.col("head") & F.col("tail") & (F.trim("text") == "")
    return found.filter(~(empty & F.col("sound"))).select("file", "block", "row", "text", "sound")
