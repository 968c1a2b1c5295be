"""The manager's dashboard: filters, key figures, breakdowns, trends."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.fixed_values import DASHBOARD_HEAD_ROWS, PRIORITIES, TRUE_WORDS_SHORT
from custvoice.functions.values import TIME, parse_bool, time_column
from custvoice.operators.kpis import count_if, text_count_pivot, value_counts
from custvoice.schema import DAY, SEQ
from custvoice.sources.columns import pad_columns

COLUMN_DEFAULTS = {
    "final_intent": "other",
    "final_complaint_type": "none",
    "final_priority": "none",
    "final_sentiment": "neutral",
    "final_sarcasm": False,
    "nlp_has_resiliation_risk": False,
}

PRIORITY_DESC = tuple(reversed(PRIORITIES))


def dashboard_base(df: DataFrame) -> DataFrame:
    """Pad the columns the dashboard needs, ``created_ts`` among them."""
    padded = pad_columns(df, COLUMN_DEFAULTS)
    return padded.withColumn(TIME, time_column(df))


def date_bounds(base: DataFrame) -> DataFrame:
    """One row: first and last day, and the number of posts with a readable time."""
    return base.agg(
        F.to_date(F.min("created_ts")).alias("first_day"),
        F.to_date(F.max("created_ts")).alias("last_day"),
        F.count("created_ts").alias("dated_posts"),
    )


def filter_posts(
    base: DataFrame,
    start: date | None = None,
    end: date | None = None,
    intents: Sequence[str] | None = None,
    sentiments: Sequence[str] | None = None,
) -> DataFrame:
    """Posts of the period with one of the intents and sentiments.

    Days are inclusive.  Without a period, posts with an unreadable time are
    dropped as long as any time is readable.  A choice left open takes every
    value there is, hence no nulls; an empty choice is no filter.
    """
    ts = F.col(TIME)
    if start is not None and end is not None:
        # Plain bounds on the stored time reach the scan; a stage written by day is
        # read for the days of the period only.
        after = F.lit(end + timedelta(days=1)).cast("timestamp")
        shown = base.where((ts >= F.lit(start).cast("timestamp")) & (ts < after))
        if DAY in base.columns:
            shown = shown.where(F.col(DAY).between(F.lit(start), F.lit(end)))
    else:
        # One readable time is enough to know; the scan stops there, and the filter is a plain one.
        dated = base.where(ts.isNotNull())
        shown = base if dated.select(TIME).limit(1).isEmpty() else dated
    return shown.where(chosen("final_intent", intents) & chosen("final_sentiment", sentiments))


def chosen(column: str, values: Sequence[str] | None) -> Column:
    """One of the values; any value at all for None, anything for an empty choice."""
    if values is None:
        return F.col(column).isNotNull()
    return F.col(column).isin(*values) if values else F.lit(True)


def chosen_complaint(types: Sequence[str] | None, priorities: Sequence[str] | None) -> Column:
    """A complaint of the types and priorities; priorities left open are those of the domain."""
    complaint = F.coalesce(F.col("final_intent") == "complaint", F.lit(False))
    urgency = PRIORITIES if priorities is None else priorities
    return complaint & chosen("final_complaint_type", types) & chosen("final_priority", urgency)


def filter_complaints(
    posts: DataFrame,
    types: Sequence[str] | None = None,
    priorities: Sequence[str] | None = None,
) -> DataFrame:
    """The complaints among the filtered posts, with one of the types and priorities."""
    return posts.where(chosen_complaint(types, priorities))


def manager_kpis(
    posts: DataFrame,
    types: Sequence[str] | None = None,
    priorities: Sequence[str] | None = None,
) -> DataFrame:
    """One row of key figures in one pass.

    ``types`` and ``priorities`` narrow the urgent complaints only.
    """
    intent = F.col("final_intent")
    high = F.col("final_priority").isin("high", "critical")
    urgent = chosen_complaint(types, priorities) & high
    figures = posts.agg(
        F.count(F.lit(1)).alias("total"),
        count_if(intent == "complaint").alias("complaints"),
        count_if(intent == "suggestion").alias("suggestions"),
        count_if(intent.isin("thanks", "praise")).alias("positive_feedback"),
        count_if(urgent).alias("urgent_complaints"),
        count_if(parse_bool(F.col("nlp_has_resiliation_risk"), TRUE_WORDS_SHORT, strip=False))
        .alias("churn_risk"),
        count_if(F.col("final_sentiment") == "negative").alias("_negative"),
    )
    share = F.when(F.col("total") > 0, F.col("_negative") / F.col("total") * 100).otherwise(0.0)
    return figures.withColumn("pct_negative", F.round(share, 6)).drop("_negative")


def by_intent(posts: DataFrame) -> DataFrame:
    return value_counts(posts, "final_intent", "intent")


def by_type(shown: DataFrame) -> DataFrame:
    return value_counts(shown, "final_complaint_type", "complaint_type")


def by_priority(shown: DataFrame) -> DataFrame:
    """Counts in the order of urgency; values outside the domain are left out."""
    counts = (
        shown.where(F.col("final_priority").isin(*PRIORITIES))
        .groupBy(F.col("final_priority").alias("priority"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.array_position(F.lit(list(PRIORITY_DESC)), F.col("priority")))


def type_priority_matrix(shown: DataFrame) -> DataFrame:
    return text_count_pivot(shown, "final_complaint_type", "final_priority", PRIORITY_DESC)


def head_of(posts: DataFrame, intents: Sequence[str], rows: int = DASHBOARD_HEAD_ROWS) -> DataFrame:
    """The first posts in file order with one of the intents."""
    columns = [c for c in ("created_at", "screen_name", "text_clean") if c in posts.columns]
    shown = posts.where(F.col("final_intent").isin(*intents))
    return shown.select(SEQ, *columns).orderBy(SEQ).limit(rows)


def suggestions(posts: DataFrame) -> DataFrame:
    return head_of(posts, ("suggestion",))


def positive_feedback(posts: DataFrame) -> DataFrame:
    return head_of(posts, ("thanks", "praise"))


def daily_volume(posts: DataFrame) -> DataFrame:
    """Posts with a text per day."""
    dated = posts.where(F.col("created_ts").isNotNull())
    with_text = F.count(F.when(F.col("text_clean") != "", 1))
    return dated.groupBy(F.to_date("created_ts").alias("day")).agg(with_text.alias("n")).orderBy(
        "day"
    )


def daily_negative(posts: DataFrame) -> DataFrame:
    """Share of negative posts per day, in percent."""
    dated = posts.where(F.col("created_ts").isNotNull())
    negative = F.when(F.col("final_sentiment") == "negative", 1.0).otherwise(0.0)
    share = F.round(F.avg(negative) * 100, 6).alias("pct_negative")
    return dated.groupBy(F.to_date("created_ts").alias("day")).agg(share).orderBy("day")


FACETS = {
    "intent": "final_intent",
    "complaint_type": "final_complaint_type",
    "priority": "final_priority",
    "sentiment": "final_sentiment",
}


def manager_facets(base: DataFrame) -> DataFrame:
    """The manager's filters: as ``facets``, but unknown priorities are offered only where no known one occurs."""
    offered = facets(base)
    strange = (F.col("facet") == "priority") & ~F.col("value").isin(*PRIORITIES)
    known = offered.agg(F.max((F.col("facet") == "priority") & ~strange).alias("known"))
    return offered.where(~strange | ~F.coalesce(known.scalar(), F.lit(False))).orderBy("facet", "place", "value")


def facets(base: DataFrame) -> DataFrame:
    """``(facet, value, place)``: the values each filter offers, without nulls.

    ``place`` orders priorities by urgency, unknown ones last; the other facets
    are ordered by value alone.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.col(column).alias("value"))
        for facet, column in FACETS.items()
    ]))
    # Distinct combinations first: a handful of rows is left to explode.
    combos = base.select(*FACETS.values()).distinct()
    values = combos.select(pairs.alias("_p")).select("_p.*").where(F.col("value").isNotNull())
    known = F.array_position(F.lit(list(PRIORITY_DESC)), F.col("value"))
    place = F.when(F.col("facet") != "priority", 0).otherwise(
        F.when(known > 0, known).otherwise(len(PRIORITIES) + 1)
    )
    return values.distinct().withColumn("place", place.cast("bigint")).orderBy(
        "facet", "place", "value"
    )
