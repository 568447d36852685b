"""The parts of a page that need nesting: lists, tables, forms, selectors, markdown.

One Arrow pass over the pages serves all of them. A page is one row, so work is spread
by the scan and nothing is shuffled. Only url, id and html enter the Python workers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crawlweave.llm.words import tidy

SLICE_PAGES = 64
SLICE_BYTES = 4 << 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class PageTree(HTMLParser):
    """Flat list of elements in document order; text and nesting are index ranges."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.nodes: list[dict] = []
        self._open: list[dict] = []
        self._n_open: Counter[str] = Counter()
        self._at: dict[str, list[int]] = {}  # positions of each tag, ascending
        self.feed(html)
        self.close()
        while self._open:
            self._leave()

    def _leave(self) -> str:
        node = self._open.pop()
        self._n_open[node["tag"]] -= 1
        self._finish(node)
        return node["tag"]

    def _finish(self, node: dict) -> None:
        node["text_end"], node["end"] = len(self.texts), len(self.nodes)

    def handle_starttag(self, tag, attrs):
        seen: dict[str, str] = {}
        for k, v in attrs:
            seen[k] = v or ""
        node = {"tag": tag, "attrs": seen, "pos": len(self.nodes), "text": len(self.texts), "ref": len(self.texts)}
        self._at.setdefault(tag, []).append(node["pos"])
        self.nodes.append(node)
        if tag in VOID:
            self._finish(node)
        else:
            self._open.append(node)
            self._n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def handle_endtag(self, tag):
        if self._n_open[tag]:
            while self._leave() != tag:
                pass

    def handle_data(self, data):
        if not (self._open and self._open[-1]["tag"] in ("script", "style")):
            self.texts.append(data)

    def text(self, node: dict) -> str:
        return "".join(self.texts[node["text"] : node["text_end"]])

    def each(self, node: dict, tag: str) -> Iterator[dict]:
        """Elements of one tag inside ``node``, without looking at others."""
        at = self._at.get(tag, [])
        for k in range(bisect_right(at, node["pos"]), len(at)):
            if at[k] >= node["end"]:
                return
            yield self.nodes[at[k]]

    def inside(self, node: dict, tags) -> list[dict]:
        return sorted((n for tag in tags for n in self.each(node, tag)), key=itemgetter("pos"))

    def find(self, *tags: str) -> list[dict]:
        return [n for n in self.nodes if n["tag"] in tags]

    def select(self, selector: str) -> list[dict]:
        """tag, .class, #id, [attr], [attr=value] and their combination on one element."""
        parts = re.findall(r"([.#]?)([\w-]+)|\[([\w:-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]", selector)

        def fits(n: dict) -> bool:
            for mark, word, name, value in parts:
                a = n["attrs"]
                if name:
                    ok = name in a and (not value or a[name] == value)
                elif mark == ".":
                    ok = word in a.get("class", "").split()
                elif mark == "#":
                    ok = a.get("id") == word
                else:
                    ok = n["tag"] == word
                if not ok:
                    return False
            return bool(parts)

        return [n for n in self.nodes if fits(n)]


def _lists(t: PageTree) -> list[dict]:
    found = [
        {"type": n["tag"], "items": [t.text(li).strip() for li in t.inside(n, ("li",))]} for n in t.find("ul", "ol")
    ]
    return [x for x in found if x["items"]]


def _tables(t: PageTree) -> list[list[list[str]]]:
    out = []
    for table in t.find("table"):
        rows = [[t.text(c).strip() for c in t.inside(r, ("td", "th"))] for r in t.inside(table, ("tr",))]
        rows = [r for r in rows if r]
        if rows:
            out.append(rows)
    return out


def _forms(t: PageTree) -> list[dict]:
    return [
        {
            "action": f["attrs"].get("action", ""),
            "method": f["attrs"].get("method", "get"),
            "fields": [
                {"type": i["attrs"].get("type", i["tag"]), "name": i["attrs"].get("name", "")}
                for i in t.inside(f, ("input", "select", "textarea"))
            ],
        }
        for f in t.find("form")
    ]


def _markdown(t: PageTree) -> str:
    """Headings, paragraphs, list items and links as Markdown blocks."""
    blocks = []
    for n in t.nodes:
        tag = n["tag"]
        is_heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if not (is_heading or tag in ("p", "li")):
            continue
        # an unclosed block ends where the next block of the same kind begins
        nested = next(t.each(n, tag), None)
        end = nested["text"] if nested else n["text_end"]
        words = " ".join("".join(t.texts[n["text"] : end]).split())
        if not words:
            continue
        anchors: list[dict] = []
        for a in t.each(n, "a"):
            if a["text"] > end or len(anchors) > 1:
                break
            if a["attrs"].get("href") and a["text_end"] <= end:
                anchors.append(a)
        if len(anchors) == 1 and " ".join(t.text(anchors[0]).split()) == words:
            words = f"[{words}]({anchors[0]['attrs']['href']})"
        blocks.append("#" * int(tag[1]) + " " + words if is_heading else ("- " if tag == "li" else "") + words)
    return "\n\n".join(blocks)


PARTS = {
    "lists": (_lists, "array<struct<type:string,items:array<string>>>"),
    "tables": (_tables, "array<array<array<string>>>"),
    "forms": (_forms, "array<struct<action:string,method:string,fields:array<struct<type:string,name:string>>>>"),
    "markdown": (_markdown, "string"),
}


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``SLICE_PAGES`` rows, and ``SLICE_BYTES`` of ``column`` unless one row has more."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and (i - lo == SLICE_PAGES or total + size > SLICE_BYTES):
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield batch.slice(lo)


def _parsed(pages: DataFrame, values: Callable[[PageTree], list], schema: T.StructType) -> DataFrame:
    """page_id, url and the ``values`` of each page's tree; a task holds the strings of a slice of pages at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                rows = [values(PageTree(html.as_py() or "")) for html in part.column(2)]
                found = [pa.array(list(column), arrow.field(i + 2).type) for i, column in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=arrow.names)

    keys = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*keys).mapInArrow(tidy(run), schema)


def page_trees(pages: DataFrame, parts: Sequence[str] = tuple(PARTS)) -> DataFrame:
    """The wanted ``parts`` of each page, from one parse; the others are not computed."""
    makers = [PARTS[p][0] for p in parts]
    schema = T.StructType.fromDDL(", ".join(["page_id long", "url string", *[f"{p} {PARTS[p][1]}" for p in parts]]))
    return _parsed(pages, lambda t: [make(t) for make in makers], schema)


def lists_long(trees: DataFrame) -> DataFrame:
    return trees.select("page_id", F.posexplode("lists").alias("list_no", "l")).select(
        "page_id", "list_no", F.col("l.type").alias("list_type"), F.posexplode("l.items").alias("item_no", "item")
    )


def tables_long(trees: DataFrame) -> DataFrame:
    return (
        trees.select("page_id", F.posexplode("tables").alias("table_no", "t"))
        .select("page_id", "table_no", F.posexplode("t").alias("row_no", "r"))
        .select("page_id", "table_no", "row_no", F.posexplode("r").alias("col_no", "cell"))
    )


def forms_long(trees: DataFrame) -> DataFrame:
    return trees.select("page_id", F.posexplode("forms").alias("form_no", "f")).select(
        "page_id", "form_no", "f.action", "f.method", F.posexplode_outer("f.fields").alias("field_no", "x")
    ).select(
        "page_id", "form_no", "action", "method", "field_no",
        F.col("x.type").alias("field_type"), F.col("x.name").alias("field_name"),
    )


CASTS = {"text": "string", "number": "double", "boolean": "boolean", "array": "array<string>"}


def field_dataset(pages: DataFrame, fields: list[dict]) -> DataFrame:
    """Typed columns by a user schema of (name, selector, type).

    ``text`` is the first match, ``array`` all matches; numbers and booleans that do not
    parse become null.
    """
    raw = T.StructType(
        [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType())]
        + [T.StructField(f["name"], T.ArrayType(T.StringType())) for f in fields]
    )

    found = _parsed(pages, lambda t: [[t.text(n).strip() for n in t.select(f["selector"])] for f in fields], raw)
    typed = []
    for f in fields:
        kind = f.get("type", "text")
        c = F.col(f["name"])
        typed.append((c if kind == "array" else F.get(c, F.lit(0)).try_cast(CASTS[kind])).alias(f["name"]))
    return found.select("page_id", "url", *typed)
