"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from custvoice.session import scratch_dir


class Scratch:
    """Tables written once and read by later steps: a lost executor costs no recomputation of what led to them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, scratch_dir(spark, label)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def release(self) -> None:
        """Let go of shuffle files of finished steps now, not when the driver next happens to collect its garbage.

        Spark's queues of events hold on to the last one they handed out, that of a finished
        query to its plan, and that to its shuffles: so an empty query follows it first.
        """
        gc.collect()
        self.spark.range(0).collect()
        self.spark._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step and no result reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, in these types: extra columns cannot clash with names made later."""
    return df.select(*(df[name].cast(kind).alias(name) for name, kind in kinds.items()))
