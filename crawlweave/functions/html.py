"""HTML expressions for the column engine.

They cover everything that does not need nesting: text, title, links, images, meta tags,
headings. Lists, tables, forms and selectors need a tree; see ``operators.page_tree``.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K
from crawlweave.functions.text import clean_text, find_all, let
from crawlweave.functions.urls import base_parts, domain, is_valid_url, resolve_in

#: Names (HTML5, with ``;`` where it is needed) and numbers that do not mean their own code point: 128 to 159 are
#: Windows-1252, controls vanish. The lookup stops at a match, so the frequent names come first.
_frequent = [n for n in (name.removeprefix("&") for name, _ in K.ENTITIES) if n in html5]
REFERENCES = (
    {n: html5[n] for n in _frequent} | html5 | {f"#{i}": "" for i in (*range(1, 9), 11, *range(14, 32), 127)}
    | {f"#{i}": bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)} | {"#0": "\ufffd", "#13": "\r"}
)

INVISIBLE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
INVISIBLE_BROWSER = INVISIBLE + r"|<noscript\b.*?</noscript\s*>"
TAGS = r"(?is)<!doctype[^>]*>|</?[a-z][^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
A_TAG = r"(?i)<a\s[^>]*>"
IMG_TAG = r"(?i)<img\s[^>]*>"
REFERENCE = r"^(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;?)"
WHOLE_REFERENCE = r"^(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;)"
META = r"(?is)<meta\s[^>]*>"
JSON_LD = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""


def unescape(c: Column, attribute: bool = False) -> Column:
    """Character references to characters, each decoded once, from left to right.

    All HTML5 names and numbers are known; numbers that are no code point give U+FFFD. Old names count without ``;`` too
    when they are a whole word, but not in attributes, where ``&copy=1`` is a query parameter. Other names stay as
    written. Null stays null.
    """
    table = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")  # one literal, parsed once by the optimizer

    def decode(part: Column) -> Column:
        ref = F.regexp_extract(part, WHOLE_REFERENCE if attribute else REFERENCE, 0)
        decimal = F.nullif(F.regexp_extract(part, "^#0*([0-9]{1,9})(?![0-9])", 1), F.lit(""))
        hexed = F.nullif(F.regexp_extract(part, "^#[xX]0*([0-9a-fA-F]{1,8})(?![0-9a-fA-F])", 1), F.lit(""))

        def replaced(v: Column) -> Column:
            ref, number = v[0], v[1].cast("long")
            valid = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
            char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(ref.startswith("#"), "\ufffd")
            known = F.try_element_at(table, F.coalesce(F.concat(F.lit("#"), v[1]), ref))
            return F.coalesce(F.concat(F.coalesce(known, char), F.substring(part, F.length(ref) + 1, F.length(part))), F.concat(F.lit("&"), part))

        return let(F.array(ref, F.coalesce(decimal, F.conv(hexed, 16, 10))), replaced)

    def all_parts(parts: Column) -> Column:
        first, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.size(parts))
        return F.concat(first, F.array_join(F.transform(rest, decode), ""))

    return let(c, lambda x: F.when(F.contains(x, F.lit("&")), let(F.split(x, "&", -1), all_parts)).otherwise(x))


def title(live: Column) -> Column:
    """Text of the first title of ``live_markup``, so that one in a comment or script does not count."""
    return clean_text(unescape(F.regexp_extract(live, TITLE, 1)))


def visible_text(html: Column, browser: bool = False) -> Column:
    """All text nodes joined without a separator, scripts, styles and comments left out."""
    hidden = INVISIBLE_BROWSER if browser else INVISIBLE
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), f"{hidden}|{TAGS.removeprefix('(?is)')}", "")
    return clean_text(unescape(bare))


def live_markup(html: Column) -> Column:
    """Markup without comments, scripts and styles, so that tags inside them do not count."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), INVISIBLE, "")


def _unquote(c: Column) -> Column:
    quoted = c.startswith('"') | c.startswith("'")
    return unescape(F.when(quoted, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c), attribute=True)


def _written(tag: Column, name: str) -> Column:
    """The value of exactly this attribute as written, quotes included; '' when the tag has none.

    Quoted values of other attributes are emptied first, so text in them is not taken for an attribute.
    """
    others = rf"""(?is)(\s{name}\s*=\s*(?:"[^"]*"|'[^']*'))|(\s[^\s=>"']+\s*=\s*)(?:"[^"]*"|'[^']*')"""
    bare = F.regexp_replace(tag, others, "$1$2")
    return F.regexp_extract(bare, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)


def _values(live: Column, tag: str, name: str) -> Column:
    written = F.transform(find_all(live, tag), lambda t: _written(t, name))
    return F.transform(F.filter(written, lambda w: w != ""), _unquote)


def _absolute(live: Column, tag: str, name: str, url: Column) -> Column:
    raw = _values(live, tag, name)
    full = let(base_parts(url), lambda base: F.transform(raw, lambda h: resolve_in(base, h)))
    return F.sort_array(F.filter(F.array_distinct(full), is_valid_url))


# The functions below take ``live`` = live_markup(html), so that it is computed once per page.


def links(live: Column, url: Column) -> Column:
    return _absolute(live, A_TAG, "href", url)


def images(live: Column, url: Column) -> Column:
    return _absolute(live, IMG_TAG, "src", url)


def links_shared(live: Column, url: Column) -> Column:
    """Second link rule: http* kept as written, fragments skipped, nothing validated."""
    raw = _values(live, A_TAG, "href")
    kept = F.filter(raw, lambda h: h.startswith("http") | ((url != "") & ~h.startswith("#")))
    full = let(
        base_parts(url),
        lambda base: F.transform(kept, lambda h: F.when(h.startswith("http"), h).otherwise(resolve_in(base, h))),
    )
    return F.sort_array(F.array_distinct(full))


def internal_links(found: Column, url: Column) -> Column:
    return let(domain(url), lambda d: F.filter(found, lambda x: domain(x) == d))


def external_links(found: Column, url: Column) -> Column:
    return let(domain(url), lambda d: F.filter(found, lambda x: domain(x) != d))


HEADING = r"(?is)<h([1-6])(?:\s[^>]*)?>.*?</h\1\s*>"


def heading_list(live: Column) -> Column:
    """(level, text) of every heading, in document order."""
    return F.transform(
        find_all(live, HEADING),
        lambda m: F.struct(F.concat(F.lit("h"), F.substring(m, 3, 1)).alias("level"), visible_text(m).alias("text")),
    )


def _by_level(found: Column, levels) -> Column:
    names = F.array(*[F.lit(f"h{i}") for i in levels])
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.transform(F.filter(found, lambda e: e["level"] == n), lambda e: e["text"])),
    )


def heading_map(live: Column) -> Column:
    """Levels h1 to h6 that occur; headings without text are left out."""
    present = let(heading_list(live), lambda e: F.map_filter(_by_level(e, range(1, 7)), lambda _, v: F.size(v) > 0))
    return F.transform_values(present, lambda _, v: F.filter(v, lambda t: t != ""))


def heading_map_fixed(live: Column) -> Column:
    """Levels h1 to h3, always present, empty headings kept."""
    return let(heading_list(live), lambda e: _by_level(e, range(1, 4)))


def attr(tag: Column, name: str) -> Column:
    return _unquote(_written(tag, name))


def meta_entries(live: Column) -> Column:
    """Every meta tag as (name, property, content), in document order."""
    names = ("name", "property", "content")

    def entry(tag: Column) -> Column:
        found = F.transform(F.array(*[_written(tag, n) for n in names]), _unquote)
        return let(found, lambda v: F.struct(*[v[i].alias(n) for i, n in enumerate(names)]))

    return F.transform(find_all(live, META), entry)


def _last_wins(entries: Column, key, value) -> Column:
    """Map from entries where a repeated key keeps its last value."""

    def build(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
        return F.map_from_arrays(
            keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["k"] == k), -1)["v"])
        )

    return let(F.transform(entries, lambda e: F.struct(key(e).alias("k"), value(e).alias("v"))), build)


def meta_map(entries: Column) -> Column:
    """name (or property) to content, both needed."""
    label = lambda e: F.when(e["name"] != "", e["name"]).otherwise(e["property"])
    usable = F.filter(entries, lambda e: (label(e) != "") & (e["content"] != ""))
    return _last_wins(usable, label, lambda e: e["content"])


def prefixed_map(entries: Column, field: str, prefix: str) -> Column:
    """``og:`` or ``twitter:`` tags with the prefix removed."""
    label = lambda e: F.replace(e[field], F.lit(prefix), F.lit(""))
    usable = F.filter(entries, lambda e: e[field].startswith(prefix) & (label(e) != "") & (e["content"] != ""))
    return _last_wins(usable, label, lambda e: e["content"])


def meta_named(entries: Column, name: str) -> Column:
    """Content of the first meta tag with this name, '' when there is none."""
    first = F.get(F.filter(entries, lambda e: e["name"] == name), F.lit(0))
    return F.coalesce(first["content"], F.lit(""))


def meta_description(entries: Column) -> Column:
    return clean_text(meta_named(entries, "description"))


def meta_keywords(entries: Column) -> Column:
    return F.filter(F.transform(F.split(meta_named(entries, "keywords"), ","), lambda k: F.trim(k)), lambda k: k != "")


def json_ld(html: Column) -> Column:
    """All JSON-LD objects merged as top-level key to JSON text; later blocks win, bad JSON is skipped."""
    blocks = find_all(html, JSON_LD, 1)
    parsed = F.transform(blocks, lambda b: F.from_json(b, "map<string,string>"))
    entries = F.flatten(F.transform(parsed, lambda m: F.coalesce(F.map_entries(m), F.array())))
    return _last_wins(entries, lambda e: e["key"], lambda e: e["value"])


def html_lang(html: Column) -> Column:
    return F.lower(attr(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang"))
