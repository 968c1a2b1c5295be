"""Parsing and formatting of single values: booleans, times, counters, priorities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.fixed_values import PRIORITIES, TIME_FORMATS, TRUE_WORDS
from custvoice.functions.text import strip_text


def parse_bool(c: Column, words: tuple[str, ...] = TRUE_WORDS, strip: bool = True) -> Column:
    """True for one of ``words`` in any case, false for anything else and for null.

    A cast is no substitute: it accepts other words and fails on the rest.
    """
    text = c.cast("string")
    if strip:
        text = strip_text(text)
    return F.coalesce(F.lower(text).isin(*words), F.lit(False))


def parse_time(
    c: Column, day_first: bool = False, formats: tuple[tuple[str, str], ...] = TIME_FORMATS
) -> Column:
    """The moment a text names; null for anything else.

    Numeric dates come with hyphens or slashes, year first or last; of the latter
    ``day_first`` says which number is the day.  They may carry a time, with a zone
    or AM and PM.  ``formats`` are tried on the rest, in their order: each is a
    pattern of texts and the format in which those are read, without the weekday.
    """
    text = strip_text(c.cast("string"))
    year_first = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    order = "$3-$2-$1" if day_first else "$3-$1-$2"
    date = F.regexp_replace(year_first, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})", order)
    half_day = F.try_to_timestamp(F.upper(date), F.lit("yyyy-M-d h:mm[:ss][ ]a"))
    numeric = F.when(date.rlike("(?i)[ap]m$"), half_day).otherwise(F.try_to_timestamp(date))
    read = F.when(date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), numeric)
    named = F.regexp_replace(text, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    for pattern, form in formats:
        read = read.when(named.rlike(pattern), F.try_to_timestamp(named, F.lit(form)))
    return read


# The parsed post time, once a stage holds it.
TIME = "created_ts"


def time_column(df: DataFrame, name: str = "created_at") -> Column:
    """The post time: as stored, or parsed, or null when the table has neither."""
    if TIME in df.columns:
        return F.col(TIME)
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    if dict(df.dtypes)[name].startswith("timestamp"):
        return F.col(name)
    return parse_time(F.col(name))


def with_count_labels(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """Add short forms of counters: ``999``, ``1.2K``, ``3.4M``; unreadable gives ``0``.

    One decimal of the double quotient, correctly rounded as the usual C
    formatting does.  Only a tie in decimal needs care: there the sign of the
    division's rounding error decides, and an exact tie goes to the even digit.

    Each step is a projection of its own, so that a value used several times is
    computed once and the generated code stays small.
    """
    number = df.withColumns({f"_{k}_text": strip_text(c) for k, c in counters.items()})
    steps = [
        {"whole": "CASE WHEN {k}_text RLIKE '^[+-]?[0-9]+$' THEN {k}_text END"},
        {"n": "try_cast({k}_whole AS BIGINT)"},
        {"unit": "CASE WHEN {k}_n >= 1000000 THEN 1000000L WHEN {k}_n >= 1000 THEN 1000L END"},
        {"q": "CAST({k}_n AS DOUBLE) / {k}_unit", "tenths": "{k}_n DIV ({k}_unit DIV 10)"},
        # Twenty times the number tells on which side of the tie it lies.  Split in
        # two halves, the quotient gives exact products, hence the exact error.
        # Of the number itself only the rest by a tenth counts, so no product overflows.
        {"side": "({k}_n % ({k}_unit DIV 10)) * 20 - {k}_unit",
         "high": "{k}_q * 134217729D - ({k}_q * 134217729D - {k}_q)"},
        {"error": "({k}_high * {k}_unit - {k}_n) + ({k}_q - {k}_high) * {k}_unit"},
        {"shown": "{k}_tenths + CAST({k}_side > 0 OR ({k}_side = 0 AND ({k}_error > 0 "
                  "OR ({k}_error = 0 AND {k}_tenths % 2 = 1))) AS BIGINT)"},
    ]
    for step in steps:
        number = number.withColumns({
            f"_{k}_{part}": F.expr(sql.format(k=f"_{k}"))
            for k in counters for part, sql in step.items()
        })
    # Beyond a long: the quotient in decimal, then the double nearest to it, as a division of whole numbers
    # gives it.  Its fraction has few bits, so its tenths are exact; beyond 2 ** 53 it has none.
    large = "coalesce(CAST(try_cast({k}_whole AS DECIMAL(38, 0)) / 1000000 AS DOUBLE), CAST({k}_whole AS DOUBLE) / 1000000D)"
    tenths = f"CAST(rint({large} % 1D * 10D) AS BIGINT)"
    label = (
        "CASE WHEN {k}_n IS NULL AND {k}_whole LIKE '-%' THEN coalesce(CAST(try_cast({k}_whole AS DECIMAL(38, 0)) AS STRING), {k}_whole) "
        f"WHEN {{k}}_n IS NULL AND {{k}}_whole IS NOT NULL AND {large} >= 9007199254740992D THEN concat(format_string('%.1f', {large}), 'M') "
        f"WHEN {{k}}_n IS NULL AND {{k}}_whole IS NOT NULL THEN concat(CAST({large} - {large} % 1D AS BIGINT) + {tenths} DIV 10, '.', {tenths} % 10, 'M') "
        "WHEN {k}_n IS NULL THEN '0' WHEN {k}_unit IS NULL THEN CAST({k}_n AS STRING) "
        "ELSE concat({k}_shown DIV 10, '.', {k}_shown % 10, "
        "CASE WHEN {k}_unit = 1000 THEN 'K' ELSE 'M' END) END"
    )
    labelled = number.withColumns({k: F.expr(label.format(k=f"_{k}")) for k in counters})
    parts = ["text", *[part for step in steps for part in step]]
    return labelled.drop(*[f"_{k}_{part}" for k in counters for part in parts])


def priority_rank(c: Column) -> Column:
    """0 for ``none`` up to 4 for ``critical``; unknown and null count as ``none``."""
    rank = F.when(c == PRIORITIES[-1], len(PRIORITIES) - 1)
    for i in range(len(PRIORITIES) - 2, 0, -1):
        rank = rank.when(c == PRIORITIES[i], i)
    return rank.otherwise(0)


def priority_name(rank: Column) -> Column:
    """The priority at ``rank``, capped at the highest."""
    names = F.array(*[F.lit(p) for p in PRIORITIES])
    return F.element_at(names, F.least(rank.cast("int"), F.lit(len(PRIORITIES) - 1)) + 1)


def bump_priority(c: Column, steps: Column | int = 1) -> Column:
    """Raise a priority by ``steps``, never beyond the highest."""
    return priority_name(priority_rank(c) + steps)
