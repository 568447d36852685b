"""Quoted records and large arrays that cross lines and file splits, against the csv and json modules."""

import csv
import io
import json
import random

import pytest

from crawlweave.sources import url_files as UF


@pytest.fixture(params=[37, 1 << 27])
def split(spark, request):
    """Files are cut every 37 bytes, or not at all."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def found(rows):
    got = {}
    for r in rows.orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.url or r.error)
    return got


def wanted(text, delimiter):
    out = []
    for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter)):
        like = [c.strip() for c in row if c.strip() and ("http" in c or "." in c)]
        if len(row) > 1 and like:
            out.append(like[0])
    return out


def test_quoted_cells_with_line_breaks(spark, split, tmp_path):
    rnd = random.Random(4)
    cells = ["plain", 'say "x", y', "two\nlines", 'a\n"b"\n\nc', "", " spaced ", 'end"', "\n"]
    want = {}
    for name, d in (("a.csv", ","), ("b.csv", ";"), ("c.csv", "\t")):
        body = io.StringIO()
        w = csv.writer(body, delimiter=d, lineterminator="\n")
        w.writerow(["name", "note", "link"])
        for i in range(25):
            w.writerow([rnd.choice(cells), rnd.choice(cells), f"https://h{i}.com/?q={rnd.choice(['1', 'x,y', 'p q'])}"])
        text = body.getvalue() + f'5" pipe{d}x{d}https://last.org\nx{d}"open {d}\n{d} still"{d}https://z.org\n'
        (tmp_path / name).write_text(text)
        want[name] = wanted(text, d)
        assert len(want[name]) == 27
    assert found(UF.read_url_csv(spark, str(tmp_path))) == want


def test_unclosed_quote_falls_back_to_commas(spark, tmp_path):
    lines = "\n".join(f"https://u{i}.com, v{i}.org," for i in range(9_000))
    (tmp_path / "bad.csv").write_text('name,url\nx,"https://open.com\n' + lines + "\n")
    (tmp_path / "good.csv").write_text('name,url\n"x\ny",https://good.com\n')
    got = found(UF.read_url_csv(spark, str(tmp_path)))
    assert got["good.csv"] == ["https://good.com"]
    assert got["bad.csv"][:4] == ["name", "url", "x", '"https://open.com'] and len(got["bad.csv"]) == 4 + 18_000


def test_large_arrays(spark, split, tmp_path):
    rnd = random.Random(6)
    texts = ["a,b", 'q"uote', "back\\slash", "brack]et[", "{", "\\\\", ""]
    item = lambda i: rnd.choice([
        f"https://s{i}.com/?a=1,2", {"url": f"https://o{i}.com", "note": rnd.choice(texts)},
        {"n": [1, [2, "]"], {"x": rnd.choice(texts)}], "link": f"https://l{i}.com"}, 7, None, [1, 2], {"other": {"url": "no"}},
    ])
    want = {}
    for name, indent in (("a.json", None), ("b.json", 2)):
        items = [item(i) for i in range(40)]
        (tmp_path / name).write_text(json.dumps(items, indent=indent))
        want[name] = [x if isinstance(x, str) else x.get("url") or x.get("link") for x in items if isinstance(x, str) or isinstance(x, dict) and ("url" in x or "link" in x)]
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "object.json").write_text(json.dumps({"links": [f"https://k{i}.com" for i in range(30)], "m": {"a": [1, 2]}}))
    want["object.json"] = [f"https://k{i}.com" for i in range(30)]
    bad = ['["a.com", "b.com"', '["a.com", "b.com",]', '["a.com"], "b.com"]', '["a.com" "b.com"]', '["a.com, "b.com"]', '["a.com"] x', "[1,,2]", " ", "[", '["a", {"b": 1]}', '["a"]]']
    for i, t in enumerate(bad):
        (tmp_path / f"x{i}.json").write_text(t)
        with pytest.raises(ValueError):
            json.loads(t)
        want[f"x{i}.json"] = ["Invalid JSON format"]
    assert found(UF.read_url_json(spark, str(tmp_path))) == want
