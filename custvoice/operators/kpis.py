"""Key figures over enriched posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.fixed_values import COMPLAINT_TYPES, TOPICS
from custvoice.functions.values import parse_bool
from custvoice.sources.columns import pad_columns

# Values the type pivot shows as columns of their own; all others are summed up
# in one more column, since nothing keeps a classifier to its domain.
TYPE_DOMAIN = tuple(dict.fromkeys(COMPLAINT_TYPES + tuple(TOPICS)))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("bigint")


def value_counts(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """``(value, n)`` by falling count, then by value; nulls are left out."""
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(name or column))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), name or column)


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def complaints(df: DataFrame) -> DataFrame:
    return df.where(F.col("final_intent") == "complaint")


def global_counts(df: DataFrame) -> DataFrame:
    """One row: all posts, and complaints; ``kept_for_analysis`` is always null."""
    complaint = F.col("final_intent") == "complaint" if has_columns(df, "final_intent") else None
    return df.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.lit(None).cast("bigint").alias("kept_for_analysis"),
        (F.lit(0).cast("bigint") if complaint is None else count_if(complaint))
        .alias("complaints_final"),
    )


def _empty_counts(df: DataFrame, column: str) -> DataFrame:
    none = F.lit(None)
    return df.limit(0).select(
        none.cast("string").alias(column), none.cast("bigint").alias("n")
    )


def by_intent(df: DataFrame) -> DataFrame:
    if not has_columns(df, "final_intent"):
        return _empty_counts(df, "final_intent")
    return value_counts(df, "final_intent")


def _complaints_by(df: DataFrame, column: str) -> DataFrame:
    if not has_columns(df, "final_intent", column):
        return _empty_counts(df, column)
    return value_counts(complaints(df), column)


def complaints_by_type(df: DataFrame) -> DataFrame:
    return _complaints_by(df, "final_complaint_type")


def complaints_by_priority(df: DataFrame) -> DataFrame:
    return _complaints_by(df, "final_priority")


def text_count_pivot(df: DataFrame, row: str, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Posts with a text per ``row`` value and ``column`` value, 0 where there are none.

    The columns are the given domain plus ``other_value``: known beforehand, so
    the values need not be collected first.  Null keys are left out; an empty
    text counts as none, as it does after a round trip through CSV.
    """
    counted = F.when(F.col("text_clean") != "", 1)
    cells = [
        F.count(F.when(F.col(column) == v, counted)).alias(v) for v in domain
    ] + [F.count(F.when(~F.col(column).isin(*domain), counted)).alias("other_value")]
    keyed = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return keyed.groupBy(row).agg(*cells).orderBy(row)


def intent_type_matrix(df: DataFrame) -> DataFrame:
    if not has_columns(df, "final_intent", "final_complaint_type"):
        df = pad_columns(df.limit(0), {"final_intent": None, "final_complaint_type": None})
    return text_count_pivot(df, "final_intent", "final_complaint_type", TYPE_DOMAIN)


def compute_kpis(df: DataFrame) -> dict[str, DataFrame]:
    """All of the above, lazily; persist or store ``df`` if it is costly."""
    return {
        "global_counts": global_counts(df),
        "by_intent": by_intent(df),
        "complaints_by_type": complaints_by_type(df),
        "complaints_by_priority": complaints_by_priority(df),
        "complaint_matrix": intent_type_matrix(df),
    }


def counts_in_one_pass(df: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """``(section, key, n)`` for several value counts with one scan.

    ``wanted`` maps a section to a column name and the condition, over the wanted
    columns, under which a row counts there.  Rows are first counted per
    combination of the columns, which shrinks them before anything is exploded.
    """
    if not wanted:
        none = F.lit(None)
        return df.limit(0).select(
            none.cast("string").alias("section"), none.cast("string").alias("key"),
            none.cast("bigint").alias("n"),
        )
    names = list(dict.fromkeys(column for column, _ in wanted.values()))
    combos = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows"))
    entries = [
        F.when(
            condition & F.col(column).isNotNull(),
            F.struct(F.lit(section).alias("section"), F.col(column).alias("key")),
        )
        for section, (column, condition) in wanted.items()
    ]
    exploded = combos.select("_rows", F.explode(F.array_compact(F.array(*entries))).alias("_e"))
    return exploded.groupBy("_e.section", "_e.key").agg(F.sum("_rows").alias("n"))


def overview(df: DataFrame) -> DataFrame:
    """Long table ``(section, key, n)``: totals, structure, sentiments, categories.

    Columns that are missing simply give no lines.
    """
    true = F.lit(True)
    wanted = {}
    if has_columns(df, "tweet_type"):
        shown = F.col("tweet_type").isin("retweet", "quote")
        wanted["structure"] = ("tweet_type", shown)
    if has_columns(df, "sentiment"):
        wanted["sentiments"] = ("sentiment", true)
    if has_columns(df, "category"):
        wanted["categories"] = ("category", true)
    kept = (
        count_if(parse_bool(F.col("keep_for_analysis"))) if has_columns(df, "keep_for_analysis")
        else F.lit(0).cast("bigint")
    )
    totals = df.agg(F.count(F.lit(1)).alias("total"), kept.alias("kept")).select(
        F.explode(F.array(*[
            F.struct(F.lit("global").alias("section"), F.lit(k).alias("key"), F.col(k).alias("n"))
            for k in ("total", "kept")
        ])).alias("_e")
    ).select("_e.*")
    plural = F.when(
        F.col("section") == "structure",
        F.when(F.col("key") == "retweet", "retweets").otherwise("quotes"),
    ).otherwise(F.col("key"))
    return totals.unionByName(counts_in_one_pass(df, wanted).withColumn("key", plural))
