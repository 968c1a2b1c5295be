"""The dashboard's figures from one table of counts.

A cube holds the number of posts, and of posts with a text, for each combination of day
and of the values the dashboard filters by.  It has some hundred rows a day whatever the
number of posts, and cubes add up: each part of the input is counted once, when it
arrives, and no panel reads posts again.  Day null stands for unreadable times.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.fixed_values import PRIORITIES, TRUE_WORDS_SHORT
from custvoice.functions.values import TIME, parse_bool
from custvoice.operators import dashboard
from custvoice.operators.dashboard import PRIORITY_DESC, chosen, chosen_complaint, dashboard_base
from custvoice.operators.kpis import TYPE_DOMAIN, has_columns

DIMENSIONS = ("final_intent", "final_complaint_type", "final_priority", "final_sentiment")
CUBE = (
    "day date, final_intent string, final_complaint_type string, final_priority string, "
    "final_sentiment string, churn_risk boolean, sarcasm boolean, n bigint, n_text bigint"
)
_KEYS = ("day", *DIMENSIONS, "churn_risk", "sarcasm")


def build_cube(posts: DataFrame) -> DataFrame:
    """Counts of enriched posts; columns that are missing take the dashboard's defaults."""
    base = dashboard_base(posts)
    text = F.count(F.when(F.col("text_clean") != "", 1)) if has_columns(base, "text_clean") else F.lit(0)

    def flag(name: str, words: tuple[str, ...]) -> Column:
        return F.coalesce(parse_bool(F.col(name), words, strip=False), F.lit(False))

    return base.groupBy(
        F.to_date(TIME).alias("day"), *DIMENSIONS,
        flag("nlp_has_resiliation_risk", TRUE_WORDS_SHORT).alias("churn_risk"),
        flag("final_sarcasm", ("true",)).alias("sarcasm"),
    ).agg(F.count(F.lit(1)).alias("n"), text.cast("bigint").alias("n_text"))


def merge_cubes(*cubes: DataFrame) -> DataFrame:
    """One cube of the posts of all."""
    together = reduce(DataFrame.unionByName, cubes)
    return together.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("n_text").alias("n_text"))


def sum_if(condition: Column, measure: str = "n") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(measure))), F.lit(0)).cast("bigint")


def date_bounds(cube: DataFrame) -> DataFrame:
    """One row: first and last day, and the number of posts with a readable time."""
    return cube.agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        sum_if(F.col("day").isNotNull()).alias("dated_posts"),
    )


def filter_posts(
    cube: DataFrame,
    start: date | None = None,
    end: date | None = None,
    intents: Sequence[str] | None = None,
    sentiments: Sequence[str] | None = None,
) -> DataFrame:
    """The counts of the posts that ``dashboard.filter_posts`` keeps."""
    day = F.col("day")
    if start is not None and end is not None:
        shown = cube.where(day.between(F.lit(start), F.lit(end)))
    else:
        any_dated = cube.agg(F.max(day.isNotNull()).alias("any_dated"))
        shown = cube.where(day.isNotNull() | ~F.coalesce(any_dated.scalar(), F.lit(False)))
    return shown.where(chosen("final_intent", intents) & chosen("final_sentiment", sentiments))


def filter_complaints(
    shown: DataFrame, types: Sequence[str] | None = None, priorities: Sequence[str] | None = None
) -> DataFrame:
    return shown.where(chosen_complaint(types, priorities))


def manager_kpis(
    shown: DataFrame, types: Sequence[str] | None = None, priorities: Sequence[str] | None = None
) -> DataFrame:
    """One row of key figures; ``types`` and ``priorities`` narrow the urgent complaints only."""
    intent = F.col("final_intent")
    urgent = chosen_complaint(types, priorities) & F.col("final_priority").isin("high", "critical")
    figures = shown.agg(
        sum_if(F.lit(True)).alias("total"),
        sum_if(intent == "complaint").alias("complaints"),
        sum_if(intent == "suggestion").alias("suggestions"),
        sum_if(intent.isin("thanks", "praise")).alias("positive_feedback"),
        sum_if(urgent).alias("urgent_complaints"),
        sum_if(F.col("churn_risk")).alias("churn_risk"),
        sum_if(F.col("final_sentiment") == "negative").alias("_negative"),
    )
    share = F.when(F.col("total") > 0, F.col("_negative") / F.col("total") * 100).otherwise(0.0)
    return figures.withColumn("pct_negative", F.round(share, 6)).drop("_negative")


def value_counts(shown: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """``(value, n)`` by falling count, then by value; nulls are left out."""
    name = name or column
    known = shown.where(F.col(column).isNotNull())
    return known.groupBy(F.col(column).alias(name)).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), name)


def by_intent(shown: DataFrame) -> DataFrame:
    return value_counts(shown, "final_intent", "intent")


def by_type(shown: DataFrame) -> DataFrame:
    return value_counts(shown, "final_complaint_type", "complaint_type")


def by_priority(shown: DataFrame) -> DataFrame:
    """Counts in the order of urgency; values outside the domain are left out."""
    counts = value_counts(shown.where(F.col("final_priority").isin(*PRIORITIES)), "final_priority", "priority")
    return counts.orderBy(F.array_position(F.lit(list(PRIORITY_DESC)), F.col("priority")))


def text_pivot(shown: DataFrame, row: str, column: str, domain: Sequence[str]) -> DataFrame:
    """Posts with a text per ``row`` value and ``column`` value, as ``kpis.text_count_pivot`` gives them."""
    cells = [sum_if(F.col(column) == v, "n_text").alias(v) for v in domain]
    cells.append(sum_if(~F.col(column).isin(*domain), "n_text").alias("other_value"))
    keyed = shown.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return keyed.groupBy(row).agg(*cells).orderBy(row)


def type_priority_matrix(shown: DataFrame) -> DataFrame:
    return text_pivot(shown, "final_complaint_type", "final_priority", PRIORITY_DESC)


def intent_type_matrix(cube: DataFrame) -> DataFrame:
    return text_pivot(cube, "final_intent", "final_complaint_type", TYPE_DOMAIN)


def daily_volume(shown: DataFrame) -> DataFrame:
    """Posts with a text per day."""
    return shown.where("day is not null").groupBy("day").agg(F.sum("n_text").alias("n")).orderBy("day")


def daily_negative(shown: DataFrame) -> DataFrame:
    """Share of negative posts per day, in percent."""
    share = sum_if(F.col("final_sentiment") == "negative") / F.sum("n") * 100
    return shown.where("day is not null").groupBy("day").agg(F.round(share, 6).alias("pct_negative")).orderBy("day")


def facets(cube: DataFrame) -> DataFrame:
    """The values each filter offers, as ``dashboard.facets`` gives them."""
    return dashboard.facets(cube)


def compute_kpis(cube: DataFrame) -> dict[str, DataFrame]:
    """The key figures of a run, all from the cube."""
    complaints = cube.where("final_intent = 'complaint'")
    return {
        "global_counts": cube.agg(
            sum_if(F.lit(True)).alias("total_posts"), F.lit(None).cast("bigint").alias("kept_for_analysis"),
            sum_if(F.col("final_intent") == "complaint").alias("complaints_final"),
        ),
        "by_intent": value_counts(cube, "final_intent"),
        "complaints_by_type": value_counts(complaints, "final_complaint_type"),
        "complaints_by_priority": value_counts(complaints, "final_priority"),
        "complaint_matrix": intent_type_matrix(cube),
    }
