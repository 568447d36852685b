"""SQL fragments of the twins. They share only the fixed values with the Spark side."""

from __future__ import annotations

from crawlweave.functions import fixed as K


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def clean_text(x: str) -> str:
    collapsed = sub(x, K.WS + "+", " ")
    return sub(f"trim({collapsed}, ' ')", K.CONTROL)


def clean_content(x: str) -> str:
    kept = sub(sub(x, K.WS + "+", " "), K.CONTENT_DROP)
    return f"trim({sub(kept, '([.!?]){2,}', chr(92) + '1')}, ' ')"


def title_cut(x: str) -> str:
    out = x
    for s in K.TITLE_SUFFIXES:
        out = f"(CASE WHEN ends_with({out}, {q(s)}) THEN left({out}, length({out}) - {len(s)}) ELSE {out} END)"
    return out


SUFFIX_FREE = sub("trim(" + sub("{x}", K.WS + "+", " ") + ", ' ')", K.TITLE_DROP)

URI = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
VALID = (
    r"^https?://(?:[^\s\x0b/?#@]*@)?"
    r"(?:localhost|\d{1,3}(?:\.\d{1,3}){3}|(?:[\p{L}\p{N}_-]+\.)+(?:\p{L}{2,}|xn--[a-z0-9-]+))"
    r"(?::\d{1,5})?(?:[/?#][^\s\x0b]*)?$"
)


def uri(x: str, group: int) -> str:
    return f"regexp_extract({x}, {q(URI)}, {group})"


def domain(x: str) -> str:
    return f"lower({uri(x, 2)})"


def valid(x: str) -> str:
    return f"(regexp_matches({x}, {q(VALID)}) AND length({x}) <= 2000)"


def normalize(x: str) -> str:
    full = f"(CASE WHEN regexp_matches({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {x} ELSE 'https://' || {x} END)"
    scheme = f"lower({uri(full, 1)})"
    host = f"lower({uri(full, 2)})"
    bare = (
        f"(CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') "
        f"WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END)"
    )
    path = uri(full, 3)
    return (
        f"({scheme} || ':' || CASE WHEN {host} <> '' OR {scheme} IN ('http', 'https', 'ftp', 'file') THEN '//' ELSE '' END"
        f" || {bare} || CASE WHEN starts_with({path}, '/') THEN '' ELSE '/' END || {path}"
        f" || CASE WHEN {uri(full, 4)} <> '' THEN '?' || {uri(full, 4)} ELSE '' END"
        f" || CASE WHEN {uri(full, 5)} <> '' THEN '#' || {uri(full, 5)} ELSE '' END)"
    )


TAG_TEXT = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!doctype[^>]*>|</?[a-z][^>]*>"
)
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*"([^"]*)\""""


def unescape(x: str) -> str:
    out = x
    for name, char in K.ENTITIES:
        out = f"replace({out}, {q(name)}, {q(char)})"
    return out


def page_text(x: str) -> str:
    return clean_text(unescape(sub(x, TAG_TEXT)))


def page_title(x: str) -> str:
    return clean_text(unescape(f"regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


# links of the given pages are either absolute or start with a slash
LINKS_SQL = f"""
hrefs AS (
  SELECT page_id, url, unnest(regexp_extract_all({sub('html', HIDDEN)}, {q(HREF)}, 1)) AS raw FROM pages),
links AS (
  SELECT DISTINCT page_id, url, link FROM (
    SELECT page_id, url, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h
             ELSE lower({uri('url', 1)}) || '://' || {uri('url', 2)} || h END AS link
    FROM (SELECT page_id, url, {unescape('raw')} AS h FROM hrefs))
  WHERE {valid('link')})"""


def words_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {q(w)})" for w in words) + ")"


def hits(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {q(w)}) AS INTEGER)" for w in words) + ")"


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(K.WS + '+')}), lambda w: w <> '')"


def all_of(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def ascii_edges(x: str) -> str:
    """Accented letters become underscores: RE2 knows word borders of ASCII letters only,
    and no pattern with a border captures anything else."""
    return sub(x, r"[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}]", "_")


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def keyword_rows(src: str, key: str, text: str) -> str:
    """(key, word) rows of keyword tokens."""
    return (
        f"SELECT {key}, word FROM (SELECT {key}, unnest({all_of(f'lower({text})', K.TOKEN)}) AS word FROM {src}) "
        f"WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN {in_list(K.STOP_WORDS)}"
    )


def distinct_size(*lists: str) -> str:
    return f"len(list_distinct({' || '.join(lists)}))"


def us_phone(m: str) -> str:
    d = f"right(regexp_replace({m}, '[^0-9]', '', 'g'), 10)"
    return f"substr({d}, 1, 3) || '-' || substr({d}, 4, 3) || '-' || substr({d}, 7, 4)"


def entity_size_columns(x: str) -> str:
    """Seven columns n_<kind> over the text ``x``."""
    a = ascii_edges(x)
    comp = " || ".join(all_of(a, p, 1) for p in K.COMPANY_PATTERNS)
    plc = " || ".join(all_of(a, p, 1) for p in K.PLACE_PATTERNS)
    kw = (
        f"list_filter({all_of(f'lower({x})', K.TOKEN)}, "
        f"lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN {in_list(K.STOP_WORDS)})"
    )
    return (
        f"len(list_distinct({all_of(a, K.EMAIL)})) AS n_emails, "
        f"len({all_of(x, K.PHONE_US)}) AS n_phone_numbers, "
        f"len(list_distinct({all_of(x, K.TEXT_URL)})) AS n_urls, "
        f"len(list_distinct({all_of(x, K.SOCIAL, 1)})) AS n_social_handles, "
        f"least(len(list_distinct(list_filter({comp}, lambda c: length(c) > 2))), 10) AS n_companies, "
        f"least(len(list_distinct({plc})), 10) AS n_locations, "
        f"least(len(list_distinct({kw})), 20) AS n_keywords"
    )
