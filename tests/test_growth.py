"""Steps whose memory, shuffles or files used to grow faster than their input."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crawlweave.llm import counting
from crawlweave.llm import jaccard_join as J
from crawlweave.llm import suffix_dedup as SD
from crawlweave.operators import access as AC
from crawlweave.operators import page_tree as PT
from crawlweave.operators import quality as Q
from crawlweave.operators import skew as SK
from crawlweave.operators import vector_index as VX
from crawlweave.operators import word_index as WX
from crawlweave.plans import q_sources
from crawlweave.sources import url_files as UF
from crawlweave.session import fresh_path


def test_a_task_gathers_postings_before_the_shuffle():
    batch = pa.RecordBatch.from_arrays([pa.array([4097, 4096, 5, None, 4096]), pa.array([["a", "b", "a"], ["b"], ["b"], ["a"], None])], names=["doc", "words"])
    rows = [r for b in WX._gather([batch]) for r in b.to_pylist()]
    places = lambda r: (np.frombuffer(r["offsets"], "<i2").tolist(), np.frombuffer(r["positions"], "<u2").tolist())
    assert {(r["term"], r["block"]): places(r) for r in rows} == {
        ("a", None): ([-1], [0]), ("a", 1): ([1, 1], [0, 2]), ("b", 0): ([5], [0]), ("b", 1): ([0, 1], [0, 1])}
    assert len(rows) == 4  # not one row for each occurrence


def test_index_of_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(WX, "SLICE_WORDS", 3)
    rows = [(i % 50 - 9, "the cat of the house") for i in range(101)] + [(None, "the of"), (None, "of the of"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = fresh_path(spark, "index")
    WX.build_index(df, path)
    copies = {d: sum(r[0] == d for r in rows[:101]) for d in range(-9, 41)}
    got = {(r["term"], r["doc"]): r["positions"] for r in WX.postings(spark, path, ["the", "of"]).collect()}
    want = {("the", d): sorted([0, 3] * n) for d, n in copies.items()} | {("of", d): [2] * n for d, n in copies.items()}
    assert got == want | {("the", None): [0, 1], ("of", None): [0, 1, 2]}
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("term", "block").distinct().count()


def test_pages_are_parsed_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["u"] * 300), pa.array(["x" * 1_000_000 if i < 10 else None for i in range(300)])], names=["page_id", "url", "html"])
    parts = list(PT._slices(batch, 2))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= PT.SLICE_PAGES and sum(len(x.as_py() or "") for x in p.column(2)) <= PT.SLICE_BYTES for p in parts)


def test_page_trees_stay_in_arrow(spark):
    pages = spark.createDataFrame([(i, "u", "<ul><li>a</li></ul>" if i % 3 else None) for i in range(200)], "page_id long, url string, html string")
    trees = PT.page_trees(pages, ["lists", "markdown"])
    assert "MapInArrow" in trees._jdf.queryExecution().executedPlan().toString()
    got = {r["page_id"]: (r["lists"], r["markdown"]) for r in trees.collect()}
    assert len(got) == 200 and got[3] == ([], "") and got[1] == ([("ul", ["a"])], "- a")


def test_a_large_lookup_does_not_sort_the_facts(spark):
    facts = spark.createDataFrame([(i % 20 if i % 21 else None, i, "t") for i in range(500)], "k int, i int, text string")
    lookup = spark.createDataFrame([(k, k * 2) for k in range(0, 40, 2)], "k int, v int")
    for how in ("inner", "left"):
        joined = SK.join_lookup(facts, lookup, ["k"], how, max_rows=5)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
        want = facts.join(lookup, ["k"], how)
        assert sorted(joined.collect(), key=str) == sorted(want.select(joined.columns).collect(), key=str)


def test_nearest_places_equal_a_full_sort():
    rnd = np.random.default_rng(1)
    for n in (1, 4, 5, 6, 300):
        ids, far = rnd.permutation(n), rnd.integers(0, 4, n) / 4
        calls = VX._least(ids, far, 5)
        assert calls.tolist() == np.lexsort((ids, far))[:5].tolist()


def test_one_file_a_page_without_folders(spark, sf):
    seen, read = [], UF.read_url_json

    def look(session, path, **kw):
        seen.append([x for x in Path(path).iterdir() if x.is_dir()])
        return read(session, path, **kw)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(UF, "read_url_json", look)
        got = {r["bad"]: r["n"] for r in q_sources.read_url_json_errors(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert seen == [[]] and got == {True: pages.filter("page_id % 3 = 0").count(), False: pages.filter("page_id % 3 <> 0").count()}


def test_jobs_with_tasks_do_not_sort_the_tasks(spark):
    jobs = spark.createDataFrame([(i, "s") for i in (1, 2, 2, 3, None)], "job_id int, status string")
    tasks = spark.createDataFrame([(10, 1), (11, 2), (12, 2), (13, None), (14, 9)], "task_id int, job_id int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = AC.jobs_with_tasks(jobs, tasks)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r["job_id"], r["task_id"]) for r in joined.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert got == sorted([(1, 10), (2, 11), (2, 12), (2, 11), (2, 12), (3, None), (None, None)], key=str)


def test_only_wide_sketches_are_stored(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(700))), (2, "a b c d"), (3, None)], "doc_id long, text string")
    rows = J.describe_sets(docs, 3, 90)
    assert "sketch" not in rows.columns
    for r in rows.filter("n > 0").withColumn("sketch", J._sketch(F.col("wide"))).collect():
        want = np.bitwise_xor.reduce(np.array(r["wide"], np.int64).reshape(-1, J.SKETCH_LONGS), axis=0)
        assert r["sketch"] == want.tolist()


def test_whitespace_of_a_text_is_collapsed_once(spark):
    texts = ["The  and\u2003or\t\tbut in\non at", " the and or * * but in on", "A\x85b\xa0 c ..  !? d é", "x", "", None, " \n ", "Of of OF the * the\u3000by with at on in to for"]
    rows = spark.createDataFrame([(i, "https://a.example.com/x", "t", t, ["l"]) for i, t in enumerate(texts)], "doc_id int, url string, title string, content string, links array<string>")
    done = Q.process_records(rows)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(content") == 1  # twice before, and once more for the cleaned text
    assert "_flat" not in Q.with_quality(rows).columns
    got = {r["doc_id"]: (r["enhancements"]["content_stats"]["word_count"], r["enhancements"]["language"], r["cleaned_content"], r["processed_data_size"]) for r in done.collect()}
    clean = rows.select("doc_id", Q.X.clean_content(F.col("content")).alias("c"), F.col("content").alias("t")).collect()
    spaces = r"[\s\x0b\x1c-\x1f\x85\xa0\u2003\u3000]+"
    english = set("the and or but in on at to for of with by".split())
    for r in clean:
        words = [w for w in re.split(spaces, r["t"] or "") if w]
        language = "en" if len(english & {w.lower() for w in words}) > 5 else "unknown"
        assert got[r["doc_id"]] == (len(words), language, r["c"], len(r["c"]))


def test_near_copies_are_found_in_small_batches(spark, monkeypatch):
    name, held = "spark.sql.execution.arrow.maxRecordsPerBatch", counting.lists
    before, seen = spark.conf.get(name), []
    monkeypatch.setattr(J, "materialize", lambda df, label, f=J.materialize: (seen.append(int(spark.conf.get(name))), f(df, label))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n {i // 2}") for i in range(40)], "doc_id long, text string")
    spark.conf.set(name, "10000")
    try:
        got = {r["id"]: r["class_id"] for r in J.classes(docs, 2, 80).collect()}
        assert spark.conf.get(name) == "10000"
    finally:
        spark.conf.set(name, before)
    assert set(seen) == {J.BATCH_ROWS} and got == {i: 0 for i in range(40)}
    parts = [(np.arange(k, k + 50, dtype=np.uint64), np.ones(50, np.int64)) for k in range(0, 500, 25)]
    assert all(sum(b.column(1).to_pylist()) <= 150 for b in held(parts, 8, 100))
    sums = counting.gathered(pa.Table.from_batches(held(parts, 1, 100)))
    assert sums[0].tolist() == list(range(525)) and sums[1].sum() == 1000


def test_shared_tokens_are_paired_where_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(J, "NEIGHBOURS", 1)
    prefixes = {g: [*range(g, g + 4), 100 + g % 2, *([999] if g < 3 else [])] for g in range(12)}
    sizes = {g: 50 + 3 * g for g in prefixes}
    rows = [(g.to_bytes(2, "big"), g, sizes[g], np.array(p, np.int64).tobytes()) for g, p in prefixes.items()]
    entries = J.shared_entries(spark.createDataFrame(rows + rows[:2], "grp binary, gid long, n long, prefix binary"), 90).collect()
    want, holders = {}, {}
    for g, p in prefixes.items():
        for i, t in enumerate(p):
            holders.setdefault(t, {})[g] = sizes[g] - i
    for t, left in holders.items():
        for g, x in left.items():
            if len(left) > 1:
                fits = lambda o: 10 * min(sizes[g], sizes[o]) >= 9 * max(sizes[g], sizes[o]) and 190 * min(x, left[o]) >= 90 * (sizes[g] + sizes[o])  # noqa: B023, E731
                want[t, g] = (sizes[g], x, len(left), sorted(o for o in left if o < g and fits(o)) if len(left) <= 4 else None)
    assert {(r["token"], r["gid"]): (r["n"], r["left"], r["c"], r["near"] if r["near"] is None else sorted(r["near"])) for r in entries} == want
    assert len(entries) == len(want) and any(v[3] for v in want.values()) and any(v[3] is None for v in want.values())


def test_only_members_of_paired_groups_are_shuffled_with_their_sketches(spark, monkeypatch):
    plans = []

    def look(df, label, f=J.materialize):
        if label in ("jaccard-near", "jaccard-rest"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, label)

    monkeypatch.setattr(J, "materialize", look)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}-{k}" for k in range(40)) + f" x{i}") for i in range(20)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["id"]: r["class_id"] for r in J.classes(docs, 3, 90).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: i // 2 * 2 for i in range(20)}
    assert len(plans) == J.MIXED_TURNS + 2
    for plan in plans:  # members are picked where they are read; sketches of the other sets stay there
        assert re.search(r"BroadcastHashJoin .*LeftSemi", plan) and "Window" not in plan


def shuffled(plan):
    """Rows that the exchanges of a finished plan wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    inner = [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + sum(shuffled(x) for x in inner)


def test_cells_and_ranges_of_suffix_dedup_exchange_few_messages(spark):
    rnd = np.random.default_rng(5)
    texts = ["".join(rnd.choice(list("abcdefgh \n"), 1_000)) for _ in range(200)]
    texts += [t[:400] + "#" + t[400:] for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = SD.remove_repeats(df, cell_bytes=10_000)
    rows = out.collect()
    cells = 250_000 // 10_000
    assert len(rows) == 250 and sum(r["n_removed"] for r in rows) == 50 * 1_000
    # two rounds after that of the samples, each asked and answered; answers aren't sent along to later rounds
    assert 250 < shuffled(out._jdf.queryExecution().executedPlan()) < 6 * cells * (cells / 2 + 2) + 250


def test_suffix_dedup_of_far_apart_and_negative_ids(spark):
    rnd = np.random.default_rng(6)
    word = lambda n: "".join(rnd.choice(list("abcdefgh"), n))
    line = word(130)
    ids = [2**62, -(2**63), -5, None, 0, 70_000, 2**40]
    df = spark.createDataFrame([(i, word(70 + k) + str(k) + line + "PQRSTUV"[k] + word(70_000 if k == 2 else 90)) for k, i in enumerate(ids)], "doc_id long, text string")
    for cell in (200, 10**6):
        got = {r["id"]: r["n_removed"] for r in SD.remove_repeats(df, cell_bytes=cell).collect()}
        assert got == {i: 0 if i == -(2**63) else 130 for i in ids}
