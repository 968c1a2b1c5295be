"""The enrichment on a stream of raw posts.

Cleaning, features and reconciliation look at one row at a time, and stored
answers are a static table, so the same operators run on a stream without any
state: a post is enriched once, in the micro-batch it arrives with.

With a scorer, each micro-batch asks about the texts that the table of answers lacks and
writes its posts to a folder of its own.  A micro-batch that is run again finds its
answers in the table and replaces its folder: no call is made and no post written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from custvoice import schema
from custvoice.config import DEFAULT, VoiceConfig
from custvoice.operators.classify import Scorer, classify_scored, classify_stored
from custvoice.operators.prepare import prepare
from custvoice.plans.enrichment import enrich_columns
from custvoice.sources.tables import balanced


def read_raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Raw posts from the Parquet files that arrive in a folder."""
    return (
        spark.readStream.schema(schema.RAW).option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def enrich_stream(raw: DataFrame, answers: DataFrame, config: VoiceConfig = DEFAULT) -> DataFrame:
    """Enriched posts; ``answers`` is a static table ``(id, llm_response)``, of which one row per id counts."""
    prepared = prepare(raw, config)
    return enrich_columns(classify_stored(prepared, answers), config)


def write_enriched_stream(
    enriched: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append to a Parquet folder, each post exactly once.

    ``once`` takes what is there and stops.  ``checkpoint`` has to be a folder
    all executors can reach.
    """
    writer = enriched.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)


# The folder of a micro-batch, as a partition of the enriched stream.
BATCH = "batch"


def write_scored_stream(
    raw: DataFrame,
    factory: Callable[[], Scorer],
    answers_path: str,
    path: str,
    checkpoint: str,
    once: bool = False,
    config: VoiceConfig = DEFAULT,
    **options: object,
) -> StreamingQuery:
    """Prepare, score and enrich a stream of raw posts into ``path``, a folder per micro-batch.

    ``answers_path`` is the table of answers that ``classify_scored`` keeps; batch jobs
    and streams may share it.  ``options`` are those of ``classify_scored``.
    """

    def write(batch: DataFrame, number: int) -> None:
        # The texts are read for their digests and again for the rows.
        # A micro-batch of few files has few splits; its row work takes all cores.
        prepared = prepare(balanced(batch), config).persist()
        try:
            verdicts = classify_scored(prepared, factory, answers_path=answers_path, **options)
            enriched = enrich_columns(verdicts, config)
            enriched.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")
        finally:
            prepared.unpersist()

    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_scored_stream(spark: SparkSession, path: str) -> DataFrame:
    """The posts written so far; ``batch`` numbers the micro-batch of each."""
    return spark.read.parquet(path).withColumn(BATCH, F.col(BATCH).cast("bigint"))
