"""CSV files with line breaks inside quotes, read by as many tasks as they have splits.

Spark splits text files at line breaks, whatever quotes they stand in.  Whether a line
begins inside quotes follows from the number of quotes before it.  So the files are read
twice: first each split tells how many quotes it holds, and how many records begin in it
if it begins outside quotes and if inside, one row for each; sums of those rows say which
it is.  Then the lines of each split are put together to records as they are read, a batch
at a time, and numbered from what the splits before hold.  No line is shuffled or sorted
but those of records that go over the border of splits, which a scan of their own finds.

A record is one value of memory, as everywhere; an unclosed quote makes the rest of its
file one record, which is put together in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARSER = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}

_SPLIT = "file string, split bigint, quotes bigint, outside bigint, inside bigint"
# What is known of a record's split: how many records begin before it in all files and in its own, how many headers up to it.
_TOLD = ("earlier", "own", "headers")
# ``goes_on``: the piece belongs to a record from a split before, and has no number.
_PIECE = "file string, split bigint, at bigint, " + "".join(f"{n} bigint, " for n in _TOLD) + "nth bigint, record string, goes_on boolean"


def csv_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files: file, split, place in the split, and how many quotes stand in it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    placed = lines.select(
        F.col("value").alias("line"), meta.file_path.alias("file"), meta.file_block_start.alias("split"),
        F.monotonically_increasing_id().alias("at"))
    return placed.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of lines of one split: a task reads splits one after the other."""
    file = batch.column("file").dictionary_encode().indices.to_numpy()
    split = batch.column("split").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for begin, end in zip(bounds, bounds[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split its quotes, and the records that begin there if it begins outside and inside quotes.

    An empty line outside quotes is no record; inside it begins none.
    """
    def told(place: tuple[str, int], counts: tuple[int, int, int]) -> pa.RecordBatch:
        rows = [pa.array([x]) for x in (*place, *counts)]
        return pa.RecordBatch.from_arrays(rows, names=["file", "split", "quotes", "outside", "inside"])

    place, quotes, outside, inside = None, 0, 0, 0
    for batch in batches:
        for lines in _runs(batch):
            here = (lines.column("file")[0].as_py(), lines.column("split")[0].as_py())
            if here != place:
                if place:
                    yield told(place, (quotes, outside, inside))
                place, quotes, outside, inside = here, 0, 0, 0
            own = lines.column("quotes").to_numpy()
            odd = (quotes + np.cumsum(own) - own) % 2 == 1
            filled = ~lines.column("empty").to_numpy(zero_copy_only=False)
            quotes += int(own.sum())
            outside += int((filled & ~odd).sum())
            inside += int((filled & odd).sum())
    if place:
        yield told(place, (quotes, outside, inside))


def _assemble(border: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's records in order: those whole in their split, or the pieces of those that go over its borders."""
    named = ["file", "split", "at", *_TOLD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, odd, nth = None, False, 0
        # Lines of a record that has not ended yet, its first line, and whether it began in a split before.
        held, first, goes_on = [], None, False

        def made(firsts: pa.RecordBatch, records: pa.Array, goes_on: bool) -> pa.RecordBatch:
            """Records that begin at ``firsts``, the last of all numbered so far."""
            numbers = pa.nulls(1, pa.int64()) if goes_on else pa.array(np.arange(nth - len(records), nth))
            columns = [*(firsts.column(n) for n in named), numbers, records.cast(pa.string()), pa.array([goes_on] * len(records), pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=[*named, "nth", "record", "goes_on"])

        def rest() -> pa.RecordBatch:
            lines = pa.concat_arrays(held)
            return made(first, _joined(lines, np.array([0, len(lines)])), goes_on)

        for batch in batches:
            for lines in _runs(batch):
                here = (lines.column("file")[0].as_py(), lines.column("split")[0].as_py())
                if here != place:
                    if held and border:
                        yield rest()
                    place, odd, nth = here, lines.column("begun")[0].as_py(), 0
                    held, goes_on = [], odd
                quotes, text = lines.column("quotes").to_numpy(), lines.column("line")
                after = (odd + np.cumsum(quotes)) % 2 == 1
                before = np.concatenate(([odd], after[:-1]))
                begin, odd = 0, bool(after[-1])
                if before[0]:
                    # Lines up to the first that ends outside quotes go on with what is held.
                    ends = np.flatnonzero(~after)
                    begin = int(ends[0]) + 1 if len(ends) else len(after)
                    first = first if held else lines.slice(0, 1)
                    held.append(text.slice(0, begin))
                    if not len(ends):
                        continue
                    if goes_on == border:
                        yield rest()
                    held, goes_on = [], False
                # Whole records, then one that is still open.
                starts, end = begin + np.flatnonzero(~before[begin:]), len(after)
                if odd:
                    starts, end = starts[:-1], int(starts[-1])
                filled = ~lines.column("empty").to_numpy(zero_copy_only=False)[starts]
                nth += int(filled.sum())
                if filled.any() and not border:
                    records = _joined(text, np.append(starts, end)).filter(pa.array(filled))
                    yield made(lines.take(pa.array(starts[filled])), records, False)
                if odd:
                    first, held = lines.slice(end, 1), [text.slice(end)]
                    nth += 1
        if held and border:
            yield rest()

    return run


def _joined(lines: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The lines from each bound to the next as one text."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), lines.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar("\n", pa.large_string()))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of CSV files as text: ``file``, ``first`` (split and place of the first line) and ``record``.

    ``number`` counts them from nought in the order of files and places, ``place`` within their file, and ``row``
    like ``number`` but without the first of each file.  Empty lines between records are left out.
    """
    lines = csv_lines(spark, path).withColumn("empty", F.col("line").isin("", "\r"))
    counts = lines.select("file", "split", "quotes", "empty").mapInArrow(_count, _SPLIT)
    # One row for each split: few enough for a window over all, and to be sent to all tasks.
    in_file, in_all = Window.partitionBy("file").orderBy("split"), Window.orderBy("file", "split")

    def before(column: str, window: WindowSpec) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    splits = counts.withColumn("begun", before("quotes", in_file) % 2 == 1)
    splits = splits.withColumn("begins", F.when(F.col("begun"), F.col("inside")).otherwise(F.col("outside")))
    splits = splits.withColumn("own", before("begins", in_file)).withColumn("earlier", before("begins", in_all))
    header = F.when((F.col("own") == 0) & (F.col("begins") > 0), 1).otherwise(0)
    upto = in_all.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.select("file", "split", "begun", *_TOLD[:2], F.sum(header).over(upto).alias("headers"))
    known = lines.join(F.broadcast(splits), ["file", "split"])
    known = known.select("file", "split", "at", "line", "quotes", "empty", "begun", *_TOLD)
    place = F.struct("split", "at")
    whole = known.mapInArrow(_assemble(border=False), _PIECE).select("file", place.alias("first"), "record", "nth", *_TOLD)

    # Two pieces a split at most: each belongs to the last one at or before it that begins a record.
    pieces = known.mapInArrow(_assemble(border=True), _PIECE).withColumn("place", place)
    first = F.max(F.when(~F.col("goes_on"), F.col("place"))).over(
        Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    joined = pieces.withColumn("first", first).groupBy("file", "first").agg(
        F.array_sort(F.collect_list(F.struct("place", "record", "nth", *_TOLD))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["record"]), "\n")
    begun = F.col("pieces")[0]
    joined = joined.select("file", "first", text.alias("record"), *(begun[n].alias(n) for n in ("nth", *_TOLD)))
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return records.select(
        "file", "first", "record", (F.col("earlier") + F.col("nth")).alias("number"),
        (F.col("own") + F.col("nth")).alias("place"), (F.col("earlier") + F.col("nth") - F.col("headers")).alias("row"))


def read_csv_split(spark: SparkSession, path: str | list[str], sequence: str | None = None) -> DataFrame:
    """All columns as strings, named by the header that every file begins with.

    ``sequence`` names a column to hold the file order: files by name, records by place.
    """
    records = csv_records(spark, path)
    head = records.where("number = 0").select("record").first()
    if head is None:
        return spark.createDataFrame([], T.StructType([T.StructField(sequence, T.LongType())] if sequence else []))
    names = spark.range(1).select(F.from_csv(F.lit(head["record"]), _schema(head["record"].count(",") + 1), _PARSER).alias("r")).first()["r"]
    names = [name for name in names if name is not None]
    parsed = records.where("place > 0").withColumn("values", F.from_csv("record", _schema(len(names)), _PARSER))
    if sequence is None:
        return parsed.select("values.*").toDF(*names)
    return parsed.select("row", "values.*").toDF(sequence, *names)


def _schema(columns: int) -> str:
    return ", ".join(f"c{k} string" for k in range(columns))
