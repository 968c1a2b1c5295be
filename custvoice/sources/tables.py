"""Readers and writers of the stages: CSV for exchange, Parquet for work."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvoice import schema
from custvoice.fixed_values import CSV_NULL_TOKENS, TRUE_WORDS_SHORT
from custvoice.functions.values import parse_bool, time_column
from custvoice.sources.columns import with_row_index

# Stages hold every text several times over, as it came and cleaned: this codec stores them in some two thirds of the usual one's bytes.
STAGE_CODEC = "zstd"

# Quotes are doubled, never escaped with a backslash.
_CSV = {"header": True, "quote": '"', "escape": '"'}


def file_system(spark: SparkSession, path: str) -> tuple:
    """The path's own file system, whichever it is, and the path as that takes it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = file_system(spark, path)
    return files.exists(hadoop_path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver."""
    files, hadoop_path = file_system(spark, path)
    out = files.create(hadoop_path)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small file; None where there is none."""
    files, hadoop_path = file_system(spark, path)
    if not files.exists(hadoop_path):
        return None
    stream = files.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename ``source``; an error where ``target`` exists."""
    files, _ = file_system(spark, source)
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    # With no option, nothing is ever replaced.
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    context.rename(fs.Path(source), fs.Path(target), options)


def replace_folder(spark: SparkSession, draft: str, path: str) -> None:
    """Put the finished folder ``draft`` in the place of ``path``, which stays as it is until then."""
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    if path_exists(spark, path):
        rename_new(spark, path, old)
    rename_new(spark, draft, path)
    remove(spark, old)


def stage_finished(spark: SparkSession, path: str) -> bool:
    """A stage counts once its writer has marked it as a whole; a stopped job leaves no mark."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    files, hadoop_path = file_system(spark, path)
    files.delete(hadoop_path, True)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    paths = list(paths)
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {paths}")


def _require(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such table: {path}")


def _scan(
    spark: SparkSession, path: str | list[str], fmt: str, line_breaks: bool = True
) -> DataFrame:
    if isinstance(path, str):
        _require(spark, path)
    if fmt == "csv":
        return spark.read.options(inferSchema=False, multiLine=line_breaks, **_CSV).csv(path)
    return spark.read.format(fmt).load(path)


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn the tokens CSV files use for "no value" into null, in string columns."""
    return df.select([
        F.when(~F.col(n).isin(*CSV_NULL_TOKENS), F.col(n)).alias(n) if t == "string" else F.col(n)
        for n, t in df.dtypes
    ])


def read_raw(
    spark: SparkSession,
    paths: str | Iterable[str],
    fmt: str = "csv",
    indexed: bool = False,
    line_breaks: bool = True,
    several: bool = False,
) -> DataFrame:
    """Raw posts, all strings, from the first path that exists, or with ``several`` from all paths.

    Header names are stripped; for CSV the null tokens become null.  ``indexed``
    adds the file order as ``_seq`` and spreads a file that does not split.

    A CSV file whose fields may hold line breaks does not split, so a large one
    is one task: say ``line_breaks=False`` where it has none, and convert to
    Parquet once in either case.
    """
    if several:
        path = list(paths)
    else:
        path = paths if isinstance(paths, str) else first_existing(spark, paths)
    scan = _scan(spark, path, fmt, line_breaks)
    df = balanced(with_row_index(scan, schema.SEQ), scan) if indexed else scan
    df = df.toDF(*[name.strip() for name in df.columns])
    return null_tokens(df) if fmt == "csv" else df


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table, or None when it does not exist."""
    if not path_exists(spark, path):
        return None
    return read_raw(spark, path, fmt)


def balanced(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Spread a scan with fewer splits than the cluster has cores; else leave it alone.

    Meant for small or unsplittable inputs in front of heavy row work.  ``scan``
    is the plain scan under ``df``, by default ``df`` itself; counting its
    splits only plans it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if scan is None else scan).rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def read_stage(spark: SparkSession, path: str, stage: T.StructType) -> DataFrame:
    """A Parquet stage with the part of its declared schema that the table holds."""
    _require(spark, path)
    return spark.read.schema(stage).parquet(path)


def read_enriched(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Enriched posts; from CSV the typed columns are parsed back."""
    if fmt == "parquet":
        return read_stage(spark, path, schema.ENRICHED)
    return typed(read_raw(spark, path, fmt), schema.ENRICHED)


def typed(df: DataFrame, stage: T.StructType) -> DataFrame:
    """Parse the string columns of a CSV export into the stage's types."""
    kinds = {f.name: f.dataType for f in stage.fields}

    def parsed(name: str):
        kind = kinds.get(name, T.StringType())
        if isinstance(kind, T.BooleanType):
            return parse_bool(F.col(name), TRUE_WORDS_SHORT).alias(name)
        if isinstance(kind, T.ArrayType):
            return F.when(F.col(name).isNull(), F.array().cast(kind)).otherwise(
                F.split(F.col(name), ",")
            ).alias(name)
        if isinstance(kind, T.StringType):
            return F.col(name)
        return F.col(name).try_cast(kind).alias(name)

    return df.select([parsed(n) for n in df.columns])


def write_stage(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by_day: bool = False
) -> str:
    """Write a stage and return its path; missing parent folders are made.

    ``by_day`` partitions it by the day of ``created_at``, so that a dashboard
    reads the days it shows and no others.  The rebalance hint gives each day few
    and even files, and splits a day that holds much more than the others.
    For CSV, arrays become comma-joined strings.
    """
    if by_day:
        df = df.withColumn(schema.DAY, F.to_date(time_column(df))).hint("rebalance", schema.DAY)
    if fmt == "csv":
        df = df.select([
            F.concat_ws(",", F.col(n)).alias(n) if t.startswith("array") else F.col(n)
            for n, t in df.dtypes
        ])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "parquet":
        writer = writer.option("compression", STAGE_CODEC)
    if fmt == "csv":
        writer = writer.options(
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_CSV
        )
    (writer.partitionBy(schema.DAY) if by_day else writer).save(path)
    return path
