"""The feed as a stored stage: posts in the order of the feed, replies by thread.

Types, times, embedded originals, counters and numbers of replies are found once, when the
stage is written.  Its tables are:

* ``posts``: all posts as they are shown, with ``place``, their place in the feed, newest
  first, and ``kind_place``, that among the posts of their type.  Files follow the places,
  so a page, however deep, is a range of places in one or two row groups.
* ``replies``: in folders by a hash of the post they answer, ordered by post and time, so
  a thread is read from one folder, of which a very long one has several files.
* ``grams``: for each block of ``BLOCK`` places a bitmap of the three-byte strings in its
  texts and authors.  A search opens only blocks that have all those of the needle.

The driver sees counts for each of the posts' partitions, and ``STRETCHES`` stretches of
blocks at most, to which the scan of a search is narrowed in the same way at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvoice.operators import feed
from custvoice.operators.tickets import text_matches
from custvoice.schema import SEQ
from custvoice.sources.tables import STAGE_CODEC, remove, write_stage

BLOCK = 256
BITS = 1 << 15  # of a block's bitmap
LISTED = 10_000
STRETCHES = 256  # of blocks that a search reads, at most
BUCKET_ROWS = 500_000  # replies in a folder, about
ROW_GROUP = 8 << 20  # bytes


def _newest() -> list[Column]:
    return [F.desc_nulls_last("created_ts"), F.desc_nulls_last("id"), F.desc(SEQ)]


def write_feed(raw: DataFrame, path: str, buckets: int | None = None) -> Feed:
    """Write the stage under ``path`` from raw posts, and open it."""
    spark = raw.sparkSession
    typed = spark.read.parquet(write_stage(feed.feed_base(raw), f"{path}/typed"))
    placed = write_stage(_places(spark, typed, path), f"{path}/placed")
    posts = spark.read.parquet(_write_posts(typed, spark.read.parquet(placed), f"{path}/posts"))
    remove(spark, placed)
    grams = block_grams(posts)
    write_stage(grams, f"{path}/grams")

    replies = feed.replies_of(typed).withColumn("post_id", F.col("in_reply_to"))
    known = feed.posts_of(typed).select(F.col("id").alias("post_id")).distinct().withColumn("known", F.lit(True))
    replies = feed.lookup_join(replies, known, "post_id", spread=SEQ)
    replies = replies.withColumn("known", F.coalesce("known", F.lit(False)))
    if buckets is None:
        buckets = max(1, -(-feed.replies_of(typed).count() // BUCKET_ROWS))
    bucketed = replies.withColumn("bucket", _bucket(F.col("post_id"), buckets)).hint("rebalance", "bucket")
    ordered = bucketed.sortWithinPartitions("bucket", "post_id", F.asc_nulls_last("created_ts"), SEQ)
    ordered.write.mode("overwrite").options(compression=STAGE_CODEC, **{"parquet.block.size": ROW_GROUP}).partitionBy("bucket").parquet(f"{path}/replies")
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")
    return Feed(spark, path, buckets)


# Columns that are not moved until their rows' places are known, and where in the typed posts a row stands.
_HEAVY = ("full_text", "display_text")
_ROW = ("_file", "_row")


def _located(typed: DataFrame) -> DataFrame:
    meta = F.col("_metadata")
    return typed.select("*", meta.file_name.alias("_file"), meta.row_index.alias("_row"))


def _places(spark: SparkSession, typed: DataFrame, path: str) -> DataFrame:
    """Posts as they are shown, without their own texts, with their places: those before a partition are counted, those in it are numbered."""
    shown = feed.timeline(feed.posts_of(_located(typed)).drop(*_HEAVY), typed)
    keys = feed.posts_of(_located(typed)).select(*_ROW, "created_ts", "id", SEQ, "feed_type")
    laid = keys.repartitionByRange(*_newest()).sortWithinPartitions(*_newest())
    laid = laid.select(*_ROW, "feed_type", F.monotonically_increasing_id().alias("_at"))
    laid = spark.read.parquet(write_stage(laid, f"{path}/laid"))
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("part"), "feed_type").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("rows").alias("rows"), F.min("first").alias("first"))
    starts = parts.select("part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    kinds = Window.partitionBy("feed_type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kind_starts = sizes.select("part", "feed_type", F.coalesce(F.sum("rows").over(kinds), F.lit(0)).alias("kind_before"))
    # A row for each partition of the posts and type: some hundred bytes each.
    numbers = kind_starts.join(starts, "part")
    inner = Window.partitionBy("part", "feed_type").orderBy("_at")
    placed = laid.withColumn("part", part).join(F.broadcast(numbers), ["part", "feed_type"])
    placed = placed.withColumn("place", F.col("_at") + F.col("shift") + 1)
    placed = placed.withColumn("kind_place", F.col("kind_before") + F.row_number().over(inner))
    return shown.join(placed.select(*_ROW, "place", "kind_place"), list(_ROW))


def _write_posts(typed: DataFrame, placed: DataFrame, path: str) -> str:
    """Posts with their places, in files that follow them; texts move once to their row and once to their place."""
    texts = feed.posts_of(_located(typed)).select(*_ROW, *_HEAVY)
    whole = placed.join(texts, list(_ROW)).withColumn("block", F.expr(f"(place - 1) div {BLOCK}"))
    stored = whole.select(*typed.columns, *[c for c in whole.columns if c not in (*typed.columns, *_ROW)])
    ordered = stored.repartitionByRange("place").sortWithinPartitions("place")
    ordered.write.mode("overwrite").options(compression=STAGE_CODEC, **{"parquet.block.size": ROW_GROUP}).parquet(path)
    return path


def _bucket(post_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(post_id), F.lit(buckets)).cast("int")


def _positions(data: np.ndarray) -> np.ndarray:
    """The bits of the three-byte strings that begin at each byte but the last two."""
    wide = data.astype(np.uint32)
    gram = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    return (gram * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks: dict[int, np.ndarray] = {}
        for name in ("text", "author"):
            texts = batch[name].fill_null("").cast(pa.large_binary())
            for block, text in zip(batch["block"].to_pylist(), texts.to_pylist()):
                if len(text) > 2:
                    blocks.setdefault(block, np.zeros(BITS, bool))[_positions(np.frombuffer(text, np.uint8))] = True
        bitmaps = [np.packbits(b, bitorder="little").tobytes() for b in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(bitmaps, pa.binary())], names=["block", "grams"])


def block_grams(posts: DataFrame) -> DataFrame:
    """A bitmap for each block; a block that stands in several batches is put together."""
    lowered = posts.select("block", F.lower("full_text").alias("text"), F.lower("screen_name").alias("author"))
    return lowered.mapInArrow(_gram_batches, "block bigint, grams binary").groupBy("block").agg(F.bitmap_or_agg("grams").alias("grams"))


def may_hold(grams: Column, needle: str) -> Column:
    """Whether a block's bitmap has all three-byte strings of the needle."""
    found = F.lit(True)
    for bit in sorted(set(_positions(np.frombuffer(needle.lower().encode(), np.uint8)).tolist())):
        byte = F.conv(F.hex(F.substring(grams, bit // 8 + 1, 1)), 16, 10).cast("int")
        found = found & (byte.bitwiseAND(1 << bit % 8) != 0)
    return found


@dataclass(frozen=True)
class Feed:
    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Feed:
        return cls(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])

    @property
    def posts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/posts")

    @property
    def replies(self) -> DataFrame:
        # Declared, as a feed without replies has no file that tells.
        typed = self.spark.read.parquet(f"{self.path}/typed").schema
        stored = T.StructType([*typed.fields, *T.StructType.fromDDL("post_id string, known boolean, bucket int").fields])
        return self.spark.read.schema(stored).parquet(f"{self.path}/replies")

    @property
    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def page(self, number: int = 1, size: int = 20, kind: str | None = None) -> DataFrame:
        """One page of the feed, or of the posts of one type: no deeper page costs more than the first."""
        feed._check_page(number, size)
        place = "kind_place" if kind else "place"
        within = F.col(place).between((number - 1) * size + 1, number * size)
        return feed.posts_of(self.posts, kind).where(within).orderBy(place)

    def page_count(self, size: int = 20, kind: str | None = None) -> DataFrame:
        """One row: posts and pages, from the highest place."""
        place = "kind_place" if kind else "place"
        counted = feed.posts_of(self.posts, kind).agg(F.coalesce(F.max(place), F.lit(0)).alias("posts"))
        return counted.withColumn("pages", F.expr(f"(posts + {size - 1}) div {size}"))

    def thread(self, post_id: str) -> DataFrame:
        """The replies to one post, oldest first, read from one folder."""
        folder = self.spark.range(1).select(_bucket(F.lit(post_id), self.buckets)).first()[0]
        answers = self.replies.where((F.col("bucket") == folder) & (F.col("post_id") == post_id))
        return answers.drop("bucket").orderBy(F.asc_nulls_last("created_ts"), SEQ)

    def threads(self) -> DataFrame:
        """All replies to known posts; in each file by post and then oldest first."""
        return self.replies.where("known").drop("bucket", "known")

    def holding(self, needle: str) -> DataFrame:
        """The blocks that may hold the needle, however many; all of them where it is too short to tell."""
        needle = needle.strip()
        if len(needle.lower().encode()) < 3:
            return self.posts.select("block").distinct()
        return self.grams.where(may_hold(F.col("grams"), needle)).select("block")

    def blocks(self, needle: str) -> list[int] | None:
        """The blocks that may hold the needle as a list; None where it is too short to tell, or they are too many for one."""
        if len(needle.strip().lower().encode()) < 3:
            return None
        found = self.holding(needle).limit(LISTED + 1).collect()
        return None if len(found) > LISTED else sorted(r["block"] for r in found)

    def stretches(self, needle: str) -> list[tuple[int, int]]:
        """First and last blocks of the stretches that have all blocks that may hold the needle, rising.

        Each lies in a cell of its own; cells are as wide as makes them ``STRETCHES`` at most.
        """
        last = self.posts.agg(F.max("block")).first()[0] or 0
        cell = F.expr(f"block div {last // STRETCHES + 1}")
        found = self.holding(needle).groupBy(cell.alias("cell")).agg(F.min("block").alias("low"), F.max("block").alias("high"))
        return sorted((r["low"], r["high"]) for r in found.collect())

    def search(self, needle: str, kind: str | None = None) -> DataFrame:
        """Posts whose text or author holds the needle, whatever the case."""
        shown = feed.posts_of(self.posts, kind) if kind else self.posts
        needle = needle.strip()
        if not needle:
            return shown
        opened = [F.col("block").between(low, high) for low, high in self.stretches(needle)]
        shown = shown.where(reduce(or_, opened, F.lit(False)))
        return shown.where(text_matches(F.col("full_text"), needle) | text_matches(F.col("screen_name"), needle))
