"""Operators against brute force on small data, with chunks and hot groups forced."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlweave.operators import limits as L
from crawlweave.operators import maintain as M
from crawlweave.operators import metrics as ME
from crawlweave.operators import ordered as O
from crawlweave.operators import page_tree as T
from crawlweave.operators import skew as SK
from crawlweave.operators import source_health as SH
from crawlweave.operators import url_jobs as J
from crawlweave.operators.frontier import build_tasks
from crawlweave.operators.scan import replay_in_order
from crawlweave.sources import tables as TB
from crawlweave.sources import url_files as UF


@pytest.fixture(autouse=True)
def many_chunks(spark):
    """Keep range chunks small and apart, so that keys really span them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot_rows(n=3000, seed=1):
    """(key, t, id, v): one key holds most rows."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.8 else f"k{rnd.randrange(5)}", rnd.randrange(400), i, float(rnd.randrange(50))) for i in range(n)]


def test_running_and_previous(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, t int, id int, v double")
    c = O.chunked(df, ["key"], ["t", "id"])
    assert c.filter("key = 'hot'").select(O.CHUNK).distinct().count() > 2
    got = O.previous_value(O.running_sum(c, ["key"], ["t", "id"], F.col("v"), "run"), ["key"], ["t", "id"], "id", "prev").collect()
    run, prev, want = {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        run[k] = run.get(k, 0) + v
        want[i] = (run[k], prev.get(k))
        prev[k] = i
    assert {r.id: (r.run, r.prev) for r in got} == want


@pytest.mark.parametrize("hot", [1, 100, 10_000])
def test_percentiles(spark, hot, monkeypatch):
    monkeypatch.setattr(SK, "HOT_ROWS", hot)
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, t int, id int, v double")
    got = {r.key: (r.p50, r.p95, r.p99) for r in ME.percentiles(df, ["key"], "v").collect()}
    for k in {r[0] for r in rows}:
        v = [r[3] for r in rows if r[0] == k]
        assert got[k] == pytest.approx(tuple(np.percentile(v, [50, 95, 99])))


@pytest.mark.parametrize("hot", [1, 500, 10_000])
def test_join_groups(spark, hot):
    df = spark.createDataFrame(hot_rows(), "key string, t int, id int, v double")
    groups = df.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = SK.join_groups(df, groups, ["key"], "n", hot_rows=hot)
    want = df.join(groups, "key")
    cols = want.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("most", [0, 100])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_lookup(spark, most, how):
    df = spark.createDataFrame(hot_rows(), "key string, t int, id int, v double")
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "key string, d int")
    got = SK.join_lookup(df, dim, ["key"], how, max_rows=most)
    want = df.join(dim, "key", how)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_ema(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "source string, t int, id int, response_time double")
    want = {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        old = want.get(k, 0.0)
        want[k] = v if old == 0 else old * 0.8 + v * 0.2
    got = {r.source: r.ema for r in SH.response_ema(df, ["t", "id"]).collect()}
    assert got == pytest.approx(want)


def test_source_health(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = [(f"s{rnd.randrange(6)}", i, rnd.random() < 0.45) for i in range(120)]
        state = {}
        for s, i, ok in rows:
            good, bad, st = state.get(s, (0, 0, "healthy"))
            good, bad = good + ok, bad + (not ok)
            if ok:
                st = "healthy"
            elif good + bad >= 10 and bad / (good + bad) > 0.5:
                st = "unhealthy"
            state[s] = (good, bad, st)
        df = spark.createDataFrame(rows, "source string, i int, success boolean")
        got = {r.source: r.status for r in SH.source_health(df, ["i"]).collect()}
        assert got == {s: v[2] for s, v in state.items()}


def bucket(ticks, rate, burst):
    out, state = {}, {}
    for k, t, n in sorted(ticks):
        last, level = state.get(k, (t, burst * L.UNIT))
        level = min(burst * L.UNIT, level + (t - last) * round(rate * L.UNIT / 1e6))
        ok = 0
        for _ in range(n):
            if level >= L.UNIT:
                level -= L.UNIT
                ok += 1
        state[k] = (t, level)
        out[k, t] = ok
    return out


@pytest.mark.parametrize("gap", [20_000, 90_000, 110_000, 400_000])
def test_token_bucket_over_chunks(spark, gap):
    """From constant overload to idle: one key fills nearly all chunks."""
    rnd = random.Random(gap)
    t, ticks = 0, []
    for _ in range(3000):
        t += rnd.randrange(1, 2 * gap)
        ticks.append(("hot", t, rnd.choice([1, 1, 1, 2, 5])))
    ticks += [("aa", 5, 50), ("zz", 7, 3), ("zz", 2_000_000, 40)]
    df = spark.createDataFrame(ticks, "key string, t long, n long")
    got = {(r.key, r.t): r.passed for r in replay_in_order(df, L.TokenBucket(10.0, 20)).collect()}
    assert got == bucket(ticks, 10.0, 20)


def test_token_bucket_effects():
    """Chunk descriptions must agree with replays wherever they give an answer."""
    rnd = random.Random(5)
    op = L.TokenBucket(10.0, 4)
    answered = 0
    for _ in range(400):
        t = np.cumsum([rnd.randrange(1, 150_000) for _ in range(rnd.randrange(1, 40))])
        n = np.array([rnd.choice([1, 1, 2, 6]) for _ in t])
        state = [int(t[0]) - rnd.randrange(0, 300_000), rnd.randrange(0, op.cap + 1)]
        end = op.apply(op.effect(t, n), state)
        if end is not NotImplemented:
            answered += 1
            assert end == op.run(t, n, state)[1]
    assert answered > 100


@pytest.mark.parametrize("gap", [10, 300, 5000])
def test_ttl_over_chunks(spark, gap):
    rnd = random.Random(gap)
    t, ticks = 0, []
    for _ in range(3000):
        t += rnd.randrange(1, 2 * gap)
        ticks.append(("hot", t, 1))
    ticks += [("aa", 1, 1), ("zz", 1, 1), ("zz", 900, 1), ("zz", 1001, 1)]
    want, last = {}, {}
    for k, x, _ in sorted(ticks):
        ok = k not in last or x >= last[k] + 1000
        if ok:
            last[k] = x
        want[k, x] = int(ok)
    df = spark.createDataFrame(ticks, "key string, t long, n long")
    for steps in (1000, 0):  # 0: every chunk has to be scanned from its start
        op = L.TimeToLive(1000)
        op.MAX_STEPS = steps
        got = {(r.key, r.t): r.passed for r in replay_in_order(df, op).collect()}
        assert got == want


def test_batches_are_consecutive(spark):
    df = spark.range(950).select(F.lit("j").alias("job_id"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("pos"))
    got = build_tasks(df, ["pos"]).groupBy("batch_no").count().collect()
    assert {r.batch_no: r["count"] for r in got} == {i: 100 if i < 9 else 50 for i in range(10)}


def test_robots_first_line_and_own_group(spark):
    urls = spark.createDataFrame([("https://e.com/admin/x",), ("https://e.com/private/",), ("https://e.com/public/a",), ("https://e.com/",), ("https://o.org/admin/",)], "url string")
    rules = spark.createDataFrame(
        [("e.com", "*", 1, "/admin/", False), ("e.com", "*", 2, "/private/", False), ("e.com", "*", 3, "/public/", True), ("e.com", "mybot", 1, "/public/", False)],
        "host string, agent string, ord int, path string, allow boolean")
    got = {r.url: r.allowed for r in J.robots_filter(urls, rules).collect()}
    assert list(got.values()).count(False) == 2 and not got["https://e.com/admin/x"] and got["https://o.org/admin/"]
    own = {r.url: r.allowed for r in J.robots_filter(urls, rules, agent="MyBot/1.0").collect()}
    assert own["https://e.com/admin/x"] and not own["https://e.com/public/a"]


def test_retry_and_cancel(spark):
    tasks = spark.createDataFrame(
        [(1, 1, "failed", 2, 3, "e"), (2, 1, "failed", 3, 3, "e"), (3, 1, "completed", 0, 3, None), (4, 2, "pending", 0, 3, None)],
        "task_id int, job_id int, status string, retry_count int, max_retries int, error_message string")
    assert [r.task_id for r in M.can_retry(tasks).collect()] == [1]
    ids = spark.createDataFrame([(1,), (3,), (9,)], "task_id int")
    assert {r.task_id: (r.ok, r.message) for r in M.retry_outcomes(ids, tasks).collect()} == {
        1: (True, None), 3: (False, "Task 3 is not in failed status"), 9: (False, "Task 9 not found")}
    after = {r.task_id: (r.status, r.retry_count) for r in M.retry_tasks(tasks, ids).collect()}
    assert after == {1: ("pending", 2), 2: ("failed", 3), 3: ("completed", 0), 4: ("pending", 0)}


def test_text_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n\nhttps://a.com\nhttps://b.com, c.com\nsee https://d.com and http://e.com\nhttps://f.com x\n")
    got = [r.url for r in UF.read_url_text(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == ["https://a.com", "https://b.com", "c.com", "https://d.com", "http://e.com", "https://f.com x"]
    simple = [r.url for r in UF.read_url_text(spark, str(tmp_path), "simple").orderBy("pos").collect()]
    assert simple == ["https://a.com", "https://b.com, c.com", "see https://d.com and http://e.com", "https://f.com x"]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,url,"n"\n"x, y",https://a.com,1\nno,b.org,2\nplain,text,3\n')
    (tmp_path / "b.csv").write_text("https://c.com\nd.com\n")
    (tmp_path / "c.csv").write_text("id;link\n1;https://e.com/?a=1,2\n")
    got = {}
    for r in UF.read_url_csv(spark, str(tmp_path)).orderBy("file", "pos").collect():
        got.setdefault(r.file[-5:], []).append(r.url)
    assert got == {"a.csv": ["https://a.com", "b.org"], "b.csv": ["https://c.com", "d.com"], "c.csv": ["https://e.com/?a=1,2"]}


def test_json_files(spark, tmp_path):
    cases = {
        "a": '["https://a.com", {"link": "https://b.com"}, {"other": 1}, 5]',
        "b": '{"urls": ["https://c.com", {"url": "https://d.com", "priority": 1}], "metadata": {}}',
        "c": '{"href": "https://e.com"}', "d": '{"address": ["https://f.com", "g.com"]}', "e": "invalid json content",
    }
    for k, v in cases.items():
        (tmp_path / f"{k}.json").write_text(v)
    rows = UF.read_url_json(spark, str(tmp_path)).orderBy("file", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.file[-6], []).append(r.url or r.error)
    assert got == {"a": ["https://a.com", "https://b.com"], "b": ["https://c.com", "https://d.com"], "c": ["https://e.com"],
                   "d": ["https://f.com", "g.com"], "e": ["Invalid JSON format"]}


def sheet(path, rows):
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>"
        for i, r in enumerate(rows, 1))
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')


def test_workbooks_and_folder(spark, tmp_path):
    sheet(tmp_path / "a.xlsx", [["name", "url"], ["x", "https://a.com"], ["b.com", "https://a.com"], ["y", "https://c.com"]])
    (tmp_path / "bad.xlsx").write_text("not a zip")
    (tmp_path / "l.txt").write_text("https://t.com\n")
    (tmp_path / "x.pdf").write_text("?")
    rows = UF.read_urls(spark, str(tmp_path)).collect()
    assert sorted(r.url for r in rows if r.url) == ["b.com", "https://a.com", "https://c.com", "https://t.com"]
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["Failed to process Excel file", "Unsupported file format"]
    listing = {r.suffix: r.accepted for r in UF.list_files(spark, str(tmp_path)).collect()}
    assert listing == {".xlsx": True, ".txt": True, ".pdf": False}


def test_validation_counts(spark):
    rows = ["https://a.com", " https://a.com/ ", "HTTPS://A.com", "# c", "", "//x.com", "not a url", "b.com"]
    df = spark.createDataFrame([("f", i, u) for i, u in enumerate(rows)], "file string, pos int, url string")
    r = J.url_report(df).first()
    assert (r.total, r.valid, r.invalid, r.duplicates) == (8, 2, 1, 2)
    first = {x.norm_url: x.first_seen.pos for x in J.clean_urls(df).collect()}
    assert first == {"https://a.com/": 0, "https://b.com/": 7}


def test_tree_selectors():
    t = T.PageTree('<div id=a class="x y"><p data-k="v">one<p>two</div><ul><li>i<ul><li>j</ul></ul><br/><script>"</p>"</script>')
    assert [t.text(n) for n in t.select("p")] == ["onetwo", "two"]
    assert [n["tag"] for n in t.select(".y")] == ["div"] and [n["tag"] for n in t.select("#a")] == ["div"]
    assert len(t.select('p[data-k="v"]')) == 1 and t.select("div.z") == []
    assert [x["items"] for x in T._lists(t)] == [["ij", "j"], ["j"]]


def test_schemas(spark):
    for name in TB.SCHEMAS:
        assert TB.empty(spark, name).count() == 0
