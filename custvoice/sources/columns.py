"""Column-level schema evolution and row keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvoice.fixed_values import RAW_COLUMNS
from custvoice.schema import SEQ


# Longest table of file blocks to broadcast: some 150 bytes each.
MAX_BROADCAST_BLOCKS = 1_000_000


def pad_columns(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the columns that are missing, each with its default."""
    missing = {
        name: F.lit(None).cast("string") if value is None else F.lit(value)
        for name, value in defaults.items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few constant rows as a plan without any data source."""
    fields = T.StructType.fromDDL(ddl).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def pad_raw(df: DataFrame) -> DataFrame:
    """Add the missing raw columns as null strings."""
    return pad_columns(df, dict.fromkeys(RAW_COLUMNS))


def with_row_index(df: DataFrame, name: str = "_seq") -> DataFrame:
    """Dense index in file order; ``df`` has to be a plain file scan.

    The index of a row is the number of rows in the files (or file blocks)
    before its own plus its place there, so only one count per file or block is
    ever summed up, never the rows.  That table is broadcast after a check of its
    length; if there are more blocks, adaptive execution picks the join and splits
    the blocks that are too large.
    """
    meta = F.col("_metadata")
    if "row_index" in df.select(meta).schema["_metadata"].dataType.names:
        # Parquet knows each row's place in its file.
        block = {"_file": meta.file_path}
        place = meta.row_index
    else:
        # Text formats: rows of one block are read in order by one task.
        block = {"_file": meta.file_path, "_start": meta.file_block_start}
        place = F.monotonically_increasing_id()
    placed = df.select("*", *[c.alias(n) for n, c in block.items()], place.alias("_place"))
    block = list(block)
    sizes = placed.groupBy(*block).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *block, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # A scan has at most one block per split and one remainder per file.
    blocks = len(df.inputFiles()) + df.rdd.getNumPartitions()
    if blocks <= MAX_BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    indexed = placed.join(offsets, block).withColumn(
        name, F.col("_offset") + F.col("_place") - F.col("_first")
    )
    return indexed.drop("_file", "_start", "_place", "_first", "_offset")


def ticket_key(df: DataFrame) -> str | None:
    """The first id column present, or None."""
    return next((n for n in ("id", "tweet_id", "status_id") if n in df.columns), None)


def row_key(df: DataFrame, name: str) -> DataFrame:
    """Add the row's file position as a string; ``df`` holds ``_seq`` or is a file scan."""
    if SEQ in df.columns:
        return df.withColumn(name, F.col(SEQ).cast("string"))
    indexed = with_row_index(df, "_row")
    return indexed.withColumn(name, F.col("_row").cast("string")).drop("_row")


def ensure_post_id(df: DataFrame) -> DataFrame:
    """Use the row's file position as ``id`` when no row has an id."""
    if "id" in df.columns and df.where(F.col("id").isNotNull()).limit(1).count():
        return df
    return row_key(df if SEQ not in df.columns else df.drop("id"), "id")


def ensure_ticket_id(df: DataFrame) -> DataFrame:
    """Add ``ticket_id``: the first id column present, else the row's file position."""
    key = ticket_key(df)
    return df.withColumn("ticket_id", F.col(key)) if key else row_key(df, "ticket_id")
