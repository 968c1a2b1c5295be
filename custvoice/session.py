"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults that suit a cluster as well as one machine: AQE sizes the shuffles and
# splits skewed join partitions, and file splits stay well inside executor memory.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "custvoice", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder the cluster names.

    A machine-local folder is used only when the setting is absent and the
    session itself runs on one machine, as in tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="custvoice-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Stored bytes per shuffle partition to start from.  Stored text is compressed, so
# this is a few times as much in memory; what turns out small is coalesced.
SHUFFLE_BYTES = 64 << 20
# More partitions than this cost the driver more in bookkeeping than smaller ones save.
SHUFFLE_LIMIT = 50_000


def shuffle_partitions(stored: int, usual: int) -> int:
    """Partitions to start from for so many stored bytes: never fewer than usual."""
    return max(usual, min(-(-stored // SHUFFLE_BYTES), SHUFFLE_LIMIT))


@contextmanager
def shuffles_for(spark: SparkSession, path: str, stored: int | None = None) -> Iterator[int]:
    """Start shuffles with enough partitions for the table at ``path``, or for ``stored`` bytes.

    The number only ever grows: adaptive execution merges partitions that turn out
    small, but it does not split ones that are too large for memory.
    """
    if stored is None:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
        stored = files.getContentSummary(hadoop_path).getLength()
    before = spark.conf.get(_INITIAL, None)
    usual = int(before or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = shuffle_partitions(stored, usual)
    spark.conf.set(_INITIAL, str(wanted))
    try:
        yield wanted
    finally:
        if before is None:
            spark.conf.unset(_INITIAL)
        else:
            spark.conf.set(_INITIAL, before)


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listings(spark: SparkSession) -> Iterator[int]:
    """List the folders of a table that is stored in very many with a few tasks a core.

    By default each folder is a task of its own, up to 10,000 of them, which costs more than listing it.
    """
    before = spark.conf.get(_LISTING)
    tasks = min(int(before), 4 * spark.sparkContext.defaultParallelism)
    spark.conf.set(_LISTING, str(tasks))
    try:
        yield tasks
    finally:
        spark.conf.set(_LISTING, before)
