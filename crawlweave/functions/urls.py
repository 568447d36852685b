"""URL expressions.

A URL is split once by the generic URI grammar of RFC 3986 and rebuilt from its parts.
Spark's ``parse_url`` is not used: it returns null for many crawl URLs and keeps the
letter case of the scheme.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URI = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
VALID = (
    r"^https?://(?:[^\s\x0b/?#@]*@)?"
    r"(?:localhost|\d{1,3}(?:\.\d{1,3}){3}|(?:[\p{L}\p{N}_-]+\.)+(?:\p{L}{2,}|xn--[a-z0-9-]+))"
    r"(?::\d{1,5})?(?:[/?#][^\s\x0b]*)?$"
)
MAX_URL = 2000
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def part(url: Column, group: int) -> Column:
    """Scheme, netloc, path, query, fragment are groups 1 to 5; absent parts are ''."""
    return F.regexp_extract(url, URI, group)


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and empty ``?`` / ``#`` dropped, path never empty.

    Head (scheme and host) and tail are rewritten one after the other, so that the
    expression stays small enough to be generated into one stage.
    """
    full = F.regexp_replace(url, r"^(?![a-zA-Z][a-zA-Z0-9+.-]*:)", "https://")
    head = F.regexp_extract(full, r"^[^:]*:(?://[^/?#]*)?", 0)
    host = F.regexp_replace(F.lower(head), r"^(http:.*):80$|^(https:.*):443$", "$1$2")
    host = F.regexp_replace(host, r"^(https?:|ftp:|file:)$", "$1//")
    host = F.regexp_replace(host, r"^((?!https?:|ftp:|file:)[^:]*:)//$", "$1")
    tail = F.regexp_replace(F.substring(full, F.length(head) + 1, F.length(full)), r"^(?!/)", "/")
    tail = F.regexp_replace(F.regexp_replace(tail, r"^([^?#]*)\?(?=#|$)", "$1"), r"^([^#]*)#$", "$1")
    return F.concat(host, tail)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(VALID) & (F.length(url) <= MAX_URL), F.lit(False))


def domain(url: Column) -> Column:
    """Lower-cased netloc, port kept."""
    return F.lower(part(url, 2))


def storage_domain(url: Column) -> Column:
    return F.regexp_replace(domain(url), r"www\.", "")


def is_same_domain(a: Column, b: Column) -> Column:
    return F.coalesce((domain(a) == domain(b)) & (domain(a) != ""), F.lit(False))


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(part(url, 3), "/"), lambda s: s != ""))


def has_query(url: Column) -> Column:
    return part(url, 4) != ""


def is_secure(url: Column) -> Column:
    return F.lower(part(url, 1)) == "https"


def url_hash(url: Column) -> Column:
    return F.md5(normalize_url(url))


def path_template(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, UUID, "{id}"), r"/[0-9]+", "/{id}")


def _drop_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segs = F.split(F.regexp_replace(path, "^/", ""), "/")
    last = F.element_at(segs, -1)
    kept = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(tail, "/"))


def base_parts(url: Column) -> Column:
    """What ``resolve_in`` needs of the page URL, computed once per page."""
    path = part(url, 3)
    scheme = F.lower(part(url, 1))
    return F.struct(
        url.alias("url"),
        scheme.alias("scheme"),
        F.concat(scheme, F.lit("://"), part(url, 2)).alias("origin"),
        F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", "")).alias("folder"),
    )


def resolve_in(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as found on the page described by ``base_parts``.

    The frequent shapes come first and need no pattern.
    """
    has_dots = F.contains(href, F.lit("./")) | href.endswith("/..") | href.endswith("/.") | href.isin(".", "..")
    rooted = href.startswith("/") & ~href.startswith("//")
    path = F.regexp_extract(href, r"^[^?#]*", 0)
    rest = F.regexp_extract(href, r"(?s)[?#].*$", 0)
    joined = F.when(rooted, path).otherwise(F.concat(base["folder"], path))
    return (
        F.when(href.startswith("https://") | href.startswith("http://"), href)
        .when(rooted & ~has_dots, F.concat(base["origin"], href))
        .when(href == "", base["url"])
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base["url"], r"[?#].*$", ""), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base["url"], "#.*$", ""), href))
        .when(href.rlike(HAS_SCHEME), href)
        .when(has_dots, F.concat(base["origin"], _drop_dots(joined), rest))
        .otherwise(F.concat(base["origin"], base["folder"], href))
    )


def resolve(url: Column, href: Column) -> Column:
    return resolve_in(base_parts(url), href)
