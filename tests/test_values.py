import datetime

import pytest
from pyspark.sql import functions as F

from custvoice.fixed_values import PRIORITIES, TRUE_WORDS_SHORT
from custvoice.functions import values as vl


def py_count(text):
    try:
        v = int(text)
    except (TypeError, ValueError):
        return "0"
    if v >= 1_000_000:
        return f"{v / 1_000_000:.1f}M"
    return f"{v / 1_000:.1f}K" if v >= 1_000 else str(v)


def test_count_labels_round_like_c(spark):
    numbers = [*range(0, 3000, 7), *range(1000, 1_000_000, 50), 999_949, 999_950, 999_999,
               1_000_000, *range(1_000_000, 400_000_000, 50_000), 2**52, 10**15 + 50_000]
    texts = [str(n) for n in numbers] + ["-5", "+12", " 12 ", "12.7", "", "x", None, " 7 "]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, c string")
    rows = vl.with_count_labels(df, {"label": F.col("c")}).orderBy("n").collect()
    assert rows[0].__fields__ == ["n", "c", "label"]
    assert [r.label for r in rows] == [py_count(t) for t in texts]


@pytest.mark.parametrize("words, strip, expected", [
    (None, True, [True, True, True, True, False, False, False, False]),
    (TRUE_WORDS_SHORT, True, [True, True, False, False, False, False, False, False]),
    (("true",), False, [True, False, False, False, False, False, False, False]),
])
def test_parse_bool(spark, words, strip, expected):
    texts = ["True", " TRUE ", " yes", "Y", "on", "t", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, c string")
    args = (words,) if words else ()
    out = df.orderBy("n").select(vl.parse_bool(F.col("c"), *args, strip=strip)).collect()
    assert [r[0] for r in out] == expected


def test_parse_bool_keeps_booleans(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "n int, c boolean")
    out = df.orderBy("n").select(vl.parse_bool(F.col("c"))).collect()
    assert [r[0] for r in out] == [True, False, False]


def test_parse_time(spark):
    texts = ["2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05+02:00",
             "Wed Oct 10 20:19:24 +0000 2018", "hier", "12:30", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, created_at string")
    out = df.orderBy("n").select(
        F.date_format(vl.time_column(df), "yyyy-MM-dd HH:mm:ss")).collect()
    assert [r[0] for r in out] == [
        "2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 01:04:05",
        "2018-10-10 20:19:24", None, None, None, None]


@pytest.mark.parametrize("text, day_first, expected", [
    ("2024/01/03 10:00", False, "2024-01-03 10:00:00"),
    ("03/01/2024 10:00", True, "2024-01-03 10:00:00"),
    ("03/01/2024 10:00", False, "2024-03-01 10:00:00"),
    ("31/01/2024", False, None),
    ("Jan 3 2024 10:00", False, "2024-01-03 10:00:00"),
    ("Jan 3, 2024", False, "2024-01-03 00:00:00"),
    ("20240103", False, "2024-01-03 00:00:00"),
    ("Wed, 03 Jan 2024 10:00:00 GMT", False, "2024-01-03 10:00:00"),
    ("Wed, 03 Jan 2024 10:00:00 +0200", False, "2024-01-03 08:00:00"),
    ("3 Jan 2024", False, "2024-01-03 00:00:00"),
    ("2024-01-03 10:00 AM", False, "2024-01-03 10:00:00"),
    ("2024-01-03 10:05:06pm", False, "2024-01-03 22:05:06"),
    ("2024-13-45", False, None), ("99999999", False, None), ("Foo 3 2024", False, None),
])
def test_parse_time_of_other_formats(spark, text, day_first, expected):
    df = spark.createDataFrame([(text,)], "t string")
    shown = F.date_format(vl.parse_time(F.col("t"), day_first), "yyyy-MM-dd HH:mm:ss")
    assert df.select(shown).first()[0] == expected


def test_time_column_of_other_tables(spark):
    moment = datetime.datetime(2024, 1, 2, 3, 4)
    df = spark.createDataFrame([(moment,)], "created_at timestamp")
    assert df.select(vl.time_column(df)).first()[0] == moment
    assert spark.range(1).select(vl.time_column(spark.range(1))).first()[0] is None


def test_bump_priority(spark):
    cases = [(p, s) for p in [*PRIORITIES, "urgent", None] for s in range(6)]
    df = spark.createDataFrame(cases, "p string, s int")
    for row in df.select("p", "s", vl.bump_priority(F.col("p"), F.col("s")).alias("out")).collect():
        start = PRIORITIES.index(row.p) if row.p in PRIORITIES else 0
        assert row.out == PRIORITIES[min(start + row.s, 4)]


def test_count_labels_of_very_large_numbers(spark):
    numbers = ["999999999999999999", "9223372036854775807", "461168601842738790"]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    got = {r["n"]: r["label"] for r in vl.with_count_labels(df, {"label": F.col("n")}).collect()}
    assert got["999999999999999999"] == "1000000000000.0M"
    assert all(label.endswith("M") for label in got.values())


def test_count_labels_beyond_a_long(spark):
    """Whole numbers beyond a long, as Python divides and shows them: ties too, and up to where a double has no fraction."""
    numbers = [2**63 - 1, 2**63, -2**63 - 1, 99999999999999999999, -10**25]
    numbers += [10**20 + k * 10**4 for k in range(-40, 40, 3)] + [2**70 + 12345 * k for k in range(20)]
    texts = [str(n) for n in numbers] + [f" +{2**63} ", "00" + str(10**19)]
    values = numbers + [2**63, 10**19]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["label"] for r in vl.with_count_labels(df, {"label": F.col("t")}).collect()}
    assert [got[i] for i in range(len(texts))] == [str(v) if v < 1000 else f"{v / 1_000_000:.1f}M" for v in values]
