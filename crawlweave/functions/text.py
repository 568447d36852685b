"""Text expressions: cleaning, contacts, entities, language, statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlweave.functions import fixed as K


def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column used inside a lambda is otherwise evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


# the range rejects letters at once, the look-behind then tests the whole class on few characters
WS_ODD = f"[^ -~](?<=[{K.WS_ODD_SET}])"


def collapse_ws(c: Column) -> Column:
    """Whitespace runs to one space; single plain spaces are left alone, not rewritten."""
    return F.regexp_replace(F.regexp_replace(c, WS_ODD, " "), "  +", " ")


def clean_text(c: Column) -> Column:
    """Strip, turn whitespace runs into one space, drop control characters."""
    return F.regexp_replace(F.trim(collapse_ws(_s(c))), K.CONTROL, "")


def clean_content(c: Column) -> Column:
    """Keep words, whitespace and basic punctuation; a run of .!? becomes its last mark."""
    return clean_flat(collapse_ws(_s(c)))


def clean_flat(flat: Column) -> Column:
    """``clean_content`` of a text whose whitespace is collapsed."""
    kept = F.regexp_replace(flat, K.CONTENT_DROP, "")
    return F.trim(F.regexp_replace(kept, r"([.!?]){2,}", "$1"))


def clean_title(c: Column) -> Column:
    out = _s(c)
    for suffix in K.TITLE_SUFFIXES:
        out = F.regexp_replace(out, suffix.replace("|", r"\|") + r"\z", "")
    return F.regexp_replace(F.trim(collapse_ws(out)), K.TITLE_DROP, "")


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_s(c), F.lit(pattern), F.lit(group))


def _java(pattern: str, first: str = "", end: bool = True) -> str:
    """``\\b`` as a border of Unicode words on every Java version.

    Where the pattern begins with a word character (class ``first``) or ends with one, one
    look-around is enough, and testing ``first`` before it rejects most places cheaply.
    """
    if first and pattern.startswith(r"\b"):
        pattern = f"(?={first}){K.WORD_START}{pattern[2:]}"
    if end and pattern.endswith(r"\b"):
        pattern = pattern[:-2] + K.WORD_END
    return pattern.replace(r"\b", K.BORDER)


EMAIL = _java(K.EMAIL, end=False)
COMPANIES = tuple(_java(p, "[A-Z]", end="\\.?" not in p) for p in K.COMPANY_PATTERNS)
PLACES = tuple(_java(p, r"[A-Z\d]") for p in K.PLACE_PATTERNS)
PHONE_DASHED, PHONE_PAREN = _java(K.PHONE_MULTI_DASHED, r"\d"), _java(K.PHONE_MULTI_PAREN)
# text every match of the pattern contains; checked first, since most texts hold none
COMPANY_HINTS = (" (?:Inc|LLC|Corp|Co|Ltd)", " & ", "[A-Z]{3}")
PLACE_HINTS = (", [A-Z]{2}", ", [A-Z]{2}", "[0-9]{5}")


def _where(hint: Column, found: Column) -> Column:
    return F.when(hint, found).otherwise(F.array().cast("array<string>"))


def _has(c: Column, text: str) -> Column:
    return F.contains(_s(c), F.lit(text))


def _distinct_sorted(a: Column) -> Column:
    return F.sort_array(F.array_distinct(a))


def _dashed(digits: Column) -> Column:
    ten = F.right(digits, F.lit(10))
    return F.concat_ws("-", F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def emails(c: Column) -> Column:
    return _where(_has(c, "@"), _distinct_sorted(find_all(c, EMAIL)))


def phones_us(c: Column) -> Column:
    """3-3-4 numbers in document order, repeats kept."""
    found = F.transform(find_all(c, K.PHONE_US), lambda m: _dashed(_digits(m)))
    return _where(c.rlike("[0-9]{4}"), found)


def phones_multi(c: Column) -> Column:
    """Union of the four number shapes."""
    us = F.transform(find_all(c, K.PHONE_MULTI_US), lambda m: F.right(_digits(m), F.lit(10)))
    intl = F.transform(find_all(c, K.PHONE_MULTI_INTL), _digits)
    found = F.concat(us, intl, find_all(c, PHONE_DASHED), find_all(c, PHONE_PAREN))
    return _where(c.rlike("[0-9]"), _distinct_sorted(found))


def text_urls(c: Column) -> Column:
    return _where(_has(c, "://"), _distinct_sorted(find_all(c, K.TEXT_URL)))


def social_handles(c: Column) -> Column:
    return _where(_has(c, "@"), _distinct_sorted(find_all(c, K.SOCIAL, 1)))


def tokens(c: Column) -> Column:
    """Lower-case word runs, accents included."""
    return find_all(F.lower(_s(c)), K.TOKEN)


def keyword_tokens(c: Column) -> Column:
    """ASCII words of three letters or more that are not stop words, repeats kept.

    Look-around makes this one pass of the pattern, without a test per token.
    """
    stop = f"(?!(?:{'|'.join(w for w in K.STOP_WORDS if len(w) > 2)}){K.WORD_END})"
    return find_all(F.lower(_s(c)), f"(?<![a-z])(?=[a-z]){K.WORD_START}{stop}[a-z]{{3,}}{K.WORD_END}")


def keywords(c: Column, limit: int = K.KEYWORD_LIMIT) -> Column:
    """Most frequent keyword tokens of one text, count descending then word ascending.

    Sorting the tokens makes equal words neighbours, so counts are distances between run
    starts: linear after the sort, inside the row, and without a shuffle.
    """
    none = F.array().cast("array<int>")

    def rank(starts: Column, words: Column) -> Column:
        runs = F.transform(
            starts,
            lambda p, k: F.struct(
                (p - F.coalesce(F.get(starts, k + 1), F.size(words))).alias("neg"), F.get(words, p).alias("word")
            ),
        )
        return F.transform(F.slice(F.sort_array(runs), 1, limit), lambda r: r["word"])

    def count(words: Column) -> Column:
        n = F.size(words)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return let(starts, lambda s: rank(s, words))

    return let(F.sort_array(keyword_tokens(c)), count)


def keyword_count(c: Column, limit: int = K.KEYWORD_LIMIT) -> Column:
    """Size of ``keywords`` without ranking them."""
    return F.least(F.size(F.array_distinct(keyword_tokens(c))), F.lit(limit))


def _first_groups(c: Column, patterns, hints) -> Column:
    return F.concat(*[_where(c.rlike(h), find_all(c, p, 1)) for p, h in zip(patterns, hints)])


def companies(c: Column) -> Column:
    found = F.filter(_first_groups(c, COMPANIES, COMPANY_HINTS), lambda x: F.length(x) > 2)
    return _distinct_sorted(found)


def places(c: Column) -> Column:
    return _distinct_sorted(_first_groups(c, PLACES, PLACE_HINTS))


ENTITY_KINDS = {
    "emails": emails,
    "phone_numbers": phones_us,
    "urls": text_urls,
    "social_handles": social_handles,
    "companies": companies,
    "locations": places,
    "keywords": keywords,
}


LIMITED_KINDS = ("companies", "locations")


def entities(c: Column, limit: int = K.ENTITY_LIMIT) -> Column:
    """The seven kinds as one map; of companies and places a document shows the first ``limit``."""
    args: list[Column] = []
    for kind, fn in ENTITY_KINDS.items():
        found = fn(c)
        args += [F.lit(kind), F.slice(found, 1, limit) if kind in LIMITED_KINDS else found]
    return F.create_map(*args)


def word_count(c: Column) -> Column:
    return flat_word_count(collapse_ws(_s(c)))


def flat_word_count(flat: Column) -> Column:
    """``word_count`` of a text whose whitespace is collapsed."""
    return F.regexp_count(flat, F.lit("[^ ]+"))


def paragraph_count(c: Column) -> Column:
    return F.when(_s(c) == "", 0).otherwise(F.regexp_count(c, F.lit("\n\n")) + 1)


def reading_minutes(c: Column, words: Column) -> Column:
    return F.when(_s(c) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(words / 200).cast("int")))


def language_by_words(c: Column) -> Column:
    return flat_language(collapse_ws(_s(c)))


def flat_language(flat: Column) -> Column:
    """``language_by_words`` of a text whose whitespace is collapsed."""
    hits = F.size(F.array_intersect(F.split(F.lower(flat), " "), _words(K.ENGLISH_WORDS)))
    return F.when(hits > 5, "en").otherwise("unknown")


LETTER_LANGUAGES = tuple(sorted({code for code, _ in K.LANGUAGE_LETTERS} | {"en", "unknown"}))


def language_by_letters(c: Column) -> Column:
    """First rule with one of its letters in the text; plain ASCII text skips the rules."""
    out = F.when(F.length(_s(c)) < 100, "unknown").when(F.octet_length(c) == F.length(c), "en")
    for code, letters in K.LANGUAGE_LETTERS:
        out = out.when(c.rlike(f"[{_ranges(letters)}]"), code)
    return out.otherwise("en")


def _ranges(letters: str) -> str:
    """The letters as character ranges, which Java tests faster than single characters."""
    runs: list[list[int]] = []
    for code in sorted({ord(x) for x in letters}):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


def content_hash(c: Column) -> Column:
    return F.sha2(F.lower(clean_text(c)), 256)


def parse_json(c: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else; null otherwise.

    Spark's parser stops at the end of the first value. Inside brackets and inside braces
    whatever follows it becomes an error in at least one of the two.
    """
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.when(boxed.isNotNull() & (F.size(listed) == 1), F.try_variant_get(boxed, "$.v", "variant"))


def parse_value(c: Column) -> Column:
    """Stored value as a variant: parsed JSON, or the raw text when it is not JSON."""
    return F.coalesce(parse_json(c), F.to_variant_object(F.struct(c.alias("raw"))))
