"""Skew-safe lookup of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null key: the first by ``order``.

    A plain aggregate, so a key with many copies shrinks before the shuffle.
    """
    row = F.struct(*[F.col(c) for c in columns])
    picked = (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, F.col(order)).alias("_row"))
    )
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in columns])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    spread: str = "_seq",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, which holds at most one row per ``key``.

    Both sides are also dealt by a number that follows from the key, and for left
    rows without a key from ``spread``: such rows match nothing and would all go to
    one task otherwise.  As the number is part of the join's keys, both sides are
    shuffled for this join alone, so adaptive execution can split the left rows of
    a hot key over tasks, against copies of its one right-hand row.

    ``how`` is left, inner or left_semi.  The left side may be a stream.  With
    ``hot_rows``, where adaptive execution is off, keys are counted first, and those
    of more left rows are dealt by ``spread`` too, to copies of the right-hand row.
    """
    keyed = F.xxhash64(F.col(key).cast("string"))
    alone = F.xxhash64(F.lit("no key"), F.col(spread))
    dealt = left.withColumn("_deal", F.when(F.col(key).isNotNull(), keyed).otherwise(alone))
    found = right.where(F.col(key).isNotNull()).withColumn("_deal", keyed)
    on = [key, "_deal"]
    if hot_rows is not None:
        load = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_load"))
        hot = load.where(F.col("_load") >= hot_rows).select(
            key, F.ceil(F.col("_load") / F.lit(hot_rows)).cast("int").alias("_fan"))
        part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_fan")), F.lit(0)).cast("int")
        dealt = dealt.join(hot, key, "left").withColumn("_part", part).drop("_fan")
        copies = F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)
        found = found.join(hot, key, "left").withColumn("_part", F.explode(copies)).drop("_fan")
        on = [*on, "_part"]
    return dealt.join(found, on, how).drop("_deal", "_part")
