"""Text expressions: cleaning, folding, keyword tests.  Built-in functions only."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every white-space character there is, the plain space first.
_SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
_SPACES = " " + _SPACES.replace(" ", "")
# The same as a regex class body, spelled out: cheaper than Unicode regex classes.
_WS = "".join(f"\\u{ord(c):04x}" for c in _SPACES)
_URL = rf"http[^{_WS}]+|www\.[^{_WS}]+"
_TAG = r"(?U)[@#]\w*"


def strip_text(c: Column) -> Column:
    """Drop leading and trailing white space of any Unicode kind."""
    return F.btrim(c, F.lit(_SPACES))


def is_filled(c: Column) -> Column:
    """True when the value is neither null nor blank."""
    return F.coalesce(strip_text(c) != "", F.lit(False))


def collapse_spaces(c: Column) -> Column:
    """Each run of white space becomes one space; none at the ends.

    The regex runs only on texts that hold two spaces in a row.
    """
    plain = F.translate(c, _SPACES, " " * len(_SPACES))
    single = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " "))
    return F.trim(single.otherwise(plain))


def drop_urls(c: Column) -> Column:
    """The regex runs only on texts with something like a URL."""
    linked = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www."))
    return F.when(linked, F.regexp_replace(c, _URL, "")).otherwise(c)


def clean_text(c: Column, strict: bool = False) -> Column:
    """Drop URLs and tidy white space; null becomes the empty string.

    ``strict`` also drops @mentions and #hashtags and lower-cases.
    """
    text = drop_urls(F.coalesce(c, F.lit("")))
    if strict:
        text = F.lower(F.regexp_replace(text, _TAG, ""))
    return collapse_spaces(text)


@cache
def _fold_table() -> tuple[str, str]:
    """Characters to fold and what they fold to, for ``translate``.

    First the characters that decompose into one base character plus marks, with
    their bases; then the marks themselves, which have no counterpart and so are
    dropped.
    """
    source, target, marks = [], [], []
    for code in range(0x80, 0x110000):
        char = chr(code)
        base = fold_literal(char)
        if not base:
            marks.append(char)
        elif len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


def fold_literal(text: str) -> str:
    """Canonical decomposition without non-spacing marks, for literals at plan time."""
    return "".join(
        c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"
    )


def lexical_text(c: Column) -> Column:
    """Lower case, no accents, single spaces; null becomes the empty string.

    Pure ASCII texts (as many bytes as characters) skip the accent folding.
    """
    text = F.coalesce(c, F.lit(""))
    folded = F.translate(F.lower(text), *_fold_table())
    ascii_only = F.octet_length(text) == F.char_length(text)
    return collapse_spaces(F.when(ascii_only, F.lower(text)).otherwise(folded))


def live_keywords(keywords: Iterable[str], fold: bool = False) -> list[str]:
    """Keywords that can occur in a lexical text, in order and without repeats.

    A keyword with an accent, an upper-case letter or doubled spaces can never
    be found in a folded text, so it costs a scan per row for nothing.
    """
    live = []
    for keyword in keywords:
        folded = " ".join(fold_literal(keyword.lower()).split(" "))
        if fold:
            keyword = folded
        if keyword == folded and "  " not in keyword and keyword not in live:
            live.append(keyword)
    return live


def shortest_keywords(keywords: Iterable[str]) -> list[str]:
    """Drop keywords that contain another one: for "any of" tests they add nothing."""
    kept = list(dict.fromkeys(keywords))
    return [k for k in kept if not any(o != k and o in k for o in kept)]


def has_keyword(text: Column, keyword: str, known: Mapping[str, Column] = {}) -> Column:
    """Substring test; ``known`` holds the tests that were made already."""
    return known[keyword] if keyword in known else F.contains(text, F.lit(keyword))


def any_keyword(
    text: Column, keywords: Iterable[str], known: Mapping[str, Column] = {}
) -> Column:
    """True when any keyword occurs in ``text`` as a substring."""
    tests = [has_keyword(text, k, known) for k in shortest_keywords(keywords)]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def with_contains_any(
    df: DataFrame, text_col: str, wanted: Mapping[str, Iterable[str]], fold: bool = False
) -> DataFrame:
    """A boolean per entry of ``wanted``: any of its keywords occurs in the lexical text.

    The folded text is projected once and shared by all the tests.
    """
    staged = df.withColumn("_lexical", lexical_text(F.col(text_col)))
    flags = {
        name: any_keyword(F.col("_lexical"), live_keywords(words, fold))
        for name, words in wanted.items()
    }
    return staged.withColumns(flags).drop("_lexical")


def keyword_points(
    text: Column, keywords: Iterable[str], points: int, known: Mapping[str, Column] = {}
) -> Column:
    """``points`` for each keyword present, however often it occurs.

    A keyword that contains another one is looked for only where that one occurs.
    """
    words = list(keywords)
    hits = []
    for word in words:
        found = has_keyword(text, word, known)
        inner = next((w for w in words if w != word and w in word), None)
        if inner and word not in known:
            found = has_keyword(text, inner, known) & found
        hits.append(found.cast("int") * points)
    return reduce(lambda a, b: a + b, hits) if hits else F.lit(0)
