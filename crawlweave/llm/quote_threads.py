"""Conversations from quoting messages, in DataFrame operations only.

A line's quote level is the number of ``>`` in its leading run of ``>`` and spaces. "... wrote:" lines belong to no level.
Quoted passages are all lines of one level and each run of lines of one level; normalised (lower case, runs of white
space as one space) and hashed, a passage is joined to the message of the same thread whose own text, normalised alike,
has the same hash and agrees in full. Of several such messages the first is the original. Where a level is not found so,
each of its runs, and each piece of a run between empty or "[...]" lines, is looked up as an excerpt: its lines,
sentences and the whole are hashed, joined to the first message that says one of them as a line, sentence, paragraph or
whole, and the excerpt must stand in that message word by word. Excerpts that begin and end within sentences and lines
are not found. The lowest level that is found gives the parent, of several passages of it the one that comes first, so
a missing message is bridged by the one before it. Parents
are followed by doubling, so a chain of n replies takes about log2(n) rounds; each round is written to the shared folder.

Result per message: its own text without quotes and "... wrote:" lines, ``parent``, ``root`` and ``depth``; (root, depth,
order) sorts a conversation in reply order. No task gathers a thread or a conversation.

Defined cases: null bodies are empty and quote nothing. An empty own text is nobody's original. Unmatched messages are
roots. Messages are known by (thread, order); of repeated rows with the same key each gets the same parent. A parent
always has a smaller order, so there are no cycles. Empty tables give empty results. Other columns pass through as ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.session import materialize

LEAD = r"^[> ]*"
ATTRIBUTION = r"^[> ]*[^>]{1,300} wrote:\s*$"
CUT = r"\n(?:\W*\n)+"
SENTENCE = r"(?<=[.!?]) "


def level(line: Column) -> Column:
    lead = F.regexp_extract(line, LEAD, 0)
    return F.length(lead) - F.length(F.replace(lead, F.lit(">"), F.lit("")))


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def units(text: Column) -> Column:
    """Normalised lines, sentences and paragraphs of a text, and all of it."""
    one = normal(text)
    return F.array_distinct(F.filter(F.concat(
        F.array(one), F.split(one, SENTENCE, -1), F.transform(F.split(text, "\n", -1), normal), F.transform(F.split(text, r"\n\s*\n", -1), normal)
    ), lambda x: x != ""))


def parse(messages: DataFrame, body: str = "text", thread: str = "conv_id", order: str = "turn") -> DataFrame:
    """``row``, ``thread``, ``ord``, ``own`` text and ``quotes``: (level, position, raw passage) of each level and each run."""
    lines = messages.select(
        F.struct("*").alias("row"), F.col(thread).alias("thread"), F.col(order).alias("ord"), F.split(F.coalesce(F.col(body), F.lit("")), "\n", -1).alias("_lines")
    )
    lined = lines.withColumn("_levels", F.transform("_lines", lambda x: F.when(x.rlike(ATTRIBUTION), -1).otherwise(level(x))))
    lined = lined.withColumn("_at", F.arrays_zip(F.col("_lines").alias("line"), F.col("_levels").alias("lvl")))
    mine = F.transform(F.filter("_at", lambda x: x["lvl"] == 0), lambda x: x["line"])
    bare = lambda x: F.regexp_replace(x["line"], LEAD, "")
    joined = F.transform(F.filter(F.array_distinct("_levels"), lambda n: n > 0), lambda n: F.struct(
        n.alias("lvl"), F.lit(-1).alias("pos"), F.array_join(F.transform(F.filter("_at", lambda x: x["lvl"] == n), bare), "\n").alias("passage")))
    # a line that begins a run carries its level between two marks
    turn = lambda x, i: (i == 0) | (F.get("_levels", i - 1) != x["lvl"])
    marked = F.transform("_at", lambda x, i: F.concat(
        F.when(turn(x, i), F.concat(F.lit("\x01"), x["lvl"].cast("string"), F.lit("\x02"))).otherwise(F.lit("\n")), F.translate(bare(x), "\x01\x02", "  ")))
    runs = F.transform(F.split(F.array_join(marked, ""), "\x01", -1), lambda r, i: F.struct(
        F.substring_index(r, "\x02", 1).try_cast("int").alias("lvl"), i.alias("pos"), F.substring_index(r, "\x02", -1).alias("passage")))
    quotes = F.filter(F.concat(joined, F.filter(runs, lambda r: r["lvl"] > 0)), lambda q: q["passage"].rlike(r"\S"))
    return lined.select("row", "thread", "ord", F.regexp_replace(F.array_join(mine, "\n"), r"^\s+|\s+$", "").alias("own"), quotes.alias("quotes"))


def excerpts(parsed: DataFrame, links: DataFrame) -> DataFrame:
    """(thread, ord, lvl, pos, original) of passages at levels below each message's lowest level that is linked already."""
    here = [F.col("thread").eqNullSafe(F.col("_t")), F.col("ord") == F.col("_o")]
    found = links.groupBy(F.col("thread").alias("_t"), F.col("ord").alias("_o")).agg(F.min("lvl").alias("_found"))
    asked = parsed.filter(F.size("quotes") > 0).join(found, here, "left").select("thread", "ord", F.explode(F.expr(
        "filter(quotes, q -> q.pos >= 0 and (_found is null or q.lvl < _found))")).alias("q"))
    asked = asked.select("thread", "ord", "q.lvl", "q.pos", F.explode(F.concat(F.array("q.passage"), F.split("q.passage", CUT, -1))).alias("raw"))
    asked = materialize(asked.withColumn("passage", normal(F.col("raw"))).filter("passage <> ''").distinct(), "quotes-asked")
    threads = asked.select(F.col("thread").alias("_t")).distinct()
    own = parsed.select("thread", "ord", "own").filter("own <> ''").join(threads, F.col("thread").eqNullSafe(F.col("_t")), "left_semi")
    said = own.select("thread", "ord", F.explode(units(F.col("own"))).alias("_unit"))
    first = said.groupBy(F.col("thread").alias("_t"), F.xxhash64("_unit").alias("_h")).agg(F.min("ord").alias("original"))
    probes = asked.withColumn("_q", F.explode(F.transform(units(F.col("raw")), lambda u: F.xxhash64(u)))).drop("raw")
    near = probes.join(first, F.col("thread").eqNullSafe(F.col("_t")) & (F.col("_q") == F.col("_h")) & (F.col("original") < F.col("ord")))
    near = near.select("thread", "ord", "lvl", "pos", "passage", "original").distinct()
    texts = own.select(F.col("thread").alias("_t"), F.col("ord").alias("_o"), F.concat(F.lit(" "), normal(F.col("own")), F.lit(" ")).alias("_said"))
    stands = F.col("_said").contains(F.concat(F.lit(" "), F.col("passage"), F.lit(" ")))
    return near.join(texts, F.col("thread").eqNullSafe(F.col("_t")) & (F.col("original") == F.col("_o")) & stands).select("thread", "ord", "lvl", "pos", "original")


def rebuild(messages: DataFrame, body: str = "text", thread: str = "conv_id", order: str = "turn") -> DataFrame:
    """``row``, ``own``, ``parent``, ``root`` and ``depth`` of each message; the last three are orders within the thread."""
    parsed = materialize(parse(messages, body, thread, order), "quotes-parsed")
    own = parsed.select("thread", "ord", normal(F.col("own")).alias("said")).filter("said <> ''")
    # one original for each text of a thread, so a text said a thousand times is still joined once
    originals = own.groupBy(F.col("thread").alias("_thread"), F.xxhash64("said").alias("_hash"), "said").agg(F.min("ord").alias("original"))
    quoted = parsed.select("thread", "ord", F.explode("quotes").alias("q")).select("thread", "ord", "q.lvl", "q.pos", normal(F.col("q.passage")).alias("passage"))
    quoted = quoted.withColumn("_q", F.xxhash64("passage"))
    same = F.col("thread").eqNullSafe(F.col("_thread")) & (F.col("_q") == F.col("_hash")) & (F.col("passage") == F.col("said"))
    links = quoted.join(originals, same & (F.col("original") < F.col("ord"))).select("thread", "ord", "lvl", "pos", "original")
    links = materialize(links, "quotes-whole")
    links = links.unionByName(excerpts(parsed, links))
    parents = links.groupBy("thread", "ord").agg(F.min_by("original", F.struct("lvl", "pos", "original")).alias("parent"))
    here = [F.col("thread").eqNullSafe(F.col("_t")), F.col("ord") == F.col("_o")]
    keys = parsed.select("thread", "ord").distinct()
    state = keys.join(parents.withColumnsRenamed({"thread": "_t", "ord": "_o"}), here, "left").select(
        "thread", "ord", "parent", F.coalesce("parent", "ord").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")
    )
    state = materialize(state.withColumn("open", F.col("depth") > 0), "quotes-links")
    while state.filter("open").limit(1).count():
        above = state.select(F.col("thread").alias("_t"), F.col("ord").alias("_o"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        moved = state.filter("open").join(above, [F.col("thread").eqNullSafe(F.col("_t")), F.col("up") == F.col("_o")])
        moved = moved.select("thread", "ord", "parent", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("_d") > 0).alias("open"))
        # a message that has reached its root is not joined again
        state = materialize(moved.unionByName(state.filter("not open")), "quotes-links")
    found = state.select(F.col("thread").alias("_t"), F.col("ord").alias("_o"), "parent", F.col("up").alias("root"), "depth")
    return parsed.join(found, here, "left").select("row", "own", "parent", F.coalesce("root", "ord").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
