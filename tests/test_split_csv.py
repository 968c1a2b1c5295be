"""CSV with line breaks inside quotes, over splits of a few bytes, against Python's reader and Spark's own."""

import csv
import random
import re

import pytest

from custvoice.sources import split_csv, tables

VALUES = ["plain", 'say "hi", ok', "two\nlines", 'a\n\n"b"\nc, ' * 4, "", '"', '""', "é,ü\n", "\n\n\n", ",", "x" * 300, " padded "]


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def write(folder, name, rows, header=("id", "full_text", "x"), end="\n", tail=""):
    with open(folder / name, "w", newline="", encoding="utf8") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)
        file.write(tail)


@pytest.mark.parametrize("seed", range(4))
def test_records_over_many_splits(spark, small_splits, tmp_path, seed):
    r = random.Random(seed)
    rows = []
    for number, end in enumerate(("\n", "\r\n", "\n")):
        own = [[f"{number}-{k}", r.choice(VALUES), r.choice(["1", "", "z z"])] for k in range(40)]
        rows += own
        write(tmp_path, f"f{number}.csv", own, end=end, tail="\n\n" if number == 2 else "")
    df = split_csv.read_csv_split(spark, str(tmp_path), "_seq")
    assert df.columns == ["_seq", "id", "full_text", "x"]
    assert split_csv.csv_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 6
    got = df.orderBy("_seq").collect()
    assert [x["_seq"] for x in got] == list(range(120))
    assert [[x[c] or "" for c in df.columns[1:]] for x in got] == rows
    # Spark's own reader, a task for each file, agrees.
    own = tables.read_raw(spark, str(tmp_path))
    ours = tables.null_tokens(df.drop("_seq"))
    assert sorted(map(str, own.collect())) == sorted(map(str, ours.collect()))


def test_small_files(spark, tmp_path):
    write(tmp_path, "a.csv", [])
    assert split_csv.read_csv_split(spark, str(tmp_path)).collect() == []
    assert split_csv.read_csv_split(spark, str(tmp_path)).columns == ["id", "full_text", "x"]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_text("")
    assert split_csv.read_csv_split(spark, str(tmp_path / "e"), "_seq").columns == ["_seq"]
    (tmp_path / "q").mkdir()
    write(tmp_path / "q", "q.csv", [["1", "ok", ""]], header=('a "b"', "c,d", "e\nf"), tail='2,"never closed\n3,x,y\n')
    df = split_csv.read_csv_split(spark, str(tmp_path / "q"), "_seq")
    assert df.columns == ["_seq", 'a "b"', "c,d", "e\nf"]
    rows = df.orderBy("_seq").collect()
    assert len(rows) == 2 and rows[1][1] == "2"


def test_short_and_long_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1\n2,3\n4,5,6\n")
    assert [tuple(r) for r in split_csv.read_csv_split(spark, str(tmp_path), "_seq").orderBy("_seq").collect()] == [(0, "1", None), (1, "2", "3"), (2, "4", "5")]


@pytest.mark.parametrize("lines", ["1", "4"])
def test_records_over_batches(spark, small_splits, tmp_path, lines):
    """Splits that reach Python in batches of a few lines; a file of empty lines alone, and one of a header."""
    rows = [[str(k), VALUES[k % len(VALUES)], "x" * (k % 7)] for k in range(60)]
    write(tmp_path, "a.csv", [])
    (tmp_path / "b.csv").write_text("\n\r\n\n")
    write(tmp_path, "c.csv", rows, tail="\n")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, lines)
    try:
        got = split_csv.read_csv_split(spark, str(tmp_path), "_seq").orderBy("_seq").collect()
        found = split_csv.csv_records(spark, str(tmp_path)).orderBy("number").collect()
    finally:
        spark.conf.unset(batch)
    assert [[x["_seq"], *(x[c] or "" for c in ("id", "full_text", "x"))] for x in got] == [[k, *row] for k, row in enumerate(rows)]
    assert [x["number"] for x in found] == list(range(62)) and [x["place"] for x in found] == [0, *range(61)]


def test_lines_are_not_shuffled(spark, tmp_path):
    """A task holds a batch of lines, whatever the size of its split and of the file."""
    write(tmp_path, "a.csv", [[str(k), "two\nlines", ""] for k in range(5)])
    df = split_csv.read_csv_split(spark, str(tmp_path), "_seq")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    moved = [part for part in plan.split("\n\n") if re.match(r"\(\d+\) (Exchange|Sort|Window)\b", part.strip())]
    assert moved and not [part for part in moved if "line#" in part or "from_csv" in part or "values#" in part]
