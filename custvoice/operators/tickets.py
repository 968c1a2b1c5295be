"""The agents' ticket queue: complaints by priority, with status and notes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvoice.fixed_values import LABEL_TEXT_CHARS, PRIORITIES, TICKET_STATUSES, TRUE_WORDS_SHORT
from custvoice.functions.text import is_filled
from custvoice.functions.values import parse_bool, priority_rank, time_column
from custvoice.operators.lookup import lookup_join
from custvoice.schema import SEQ
from custvoice.sources.columns import ensure_ticket_id

TABLE_COLUMNS = (
    "ticket_id", "created_at", "screen_name", "text_clean", "final_complaint_type",
    "final_priority", "final_sentiment", "final_sarcasm", "is_comment",
)


def is_comment(df: DataFrame) -> Column:
    """Whether a post answers another one, from the post type or the reply target."""
    if "tweet_type" in df.columns:
        return F.coalesce(F.lower(F.col("tweet_type")) == "reply", F.lit(False))
    if "in_reply_to" in df.columns:
        return is_filled(F.col("in_reply_to"))
    return F.lit(False)


def tickets(df: DataFrame) -> DataFrame:
    """Complaints with ``ticket_id`` and ``is_comment``."""
    shown = df
    if "final_intent" in df.columns:
        shown = ensure_ticket_id(df).where(F.col("final_intent") == "complaint")
    else:
        shown = ensure_ticket_id(df)
    return shown.withColumn("is_comment", is_comment(df))


def filter_tickets(
    df: DataFrame,
    priorities: Sequence[str] | None = None,
    types: Sequence[str] | None = None,
    only_sarcasm: bool = False,
    only_churn_risk: bool = False,
    comments: bool | None = None,
    search: str = "",
    regex: bool = False,
) -> DataFrame:
    """The agents' filters; each is optional.

    ``priorities`` None means all but ``none``, ``types`` None means any; neither
    lets nulls pass.  An empty list means no filter.
    ``comments`` True shows answers only, False shows the other posts only.
    ``search`` looks for a literal in the text, whatever the case, or for a
    pattern with ``regex``.
    """
    shown = df
    if "final_priority" in df.columns:
        if priorities is None:
            shown = shown.where(F.col("final_priority") != "none")
        elif priorities:
            shown = shown.where(F.col("final_priority").isin(*priorities))
    if "final_complaint_type" in df.columns:
        if types is None:
            shown = shown.where(F.col("final_complaint_type").isNotNull())
        elif types:
            shown = shown.where(F.col("final_complaint_type").isin(*types))
    if only_sarcasm and "final_sarcasm" in df.columns:
        shown = shown.where(parse_bool(F.col("final_sarcasm"), ("true",), strip=False))
    if only_churn_risk and "nlp_has_resiliation_risk" in df.columns:
        churn = parse_bool(F.col("nlp_has_resiliation_risk"), TRUE_WORDS_SHORT, strip=False)
        shown = shown.where(churn)
    if comments is not None:
        shown = shown.where(F.col("is_comment") == comments)
    if search and "text_clean" in df.columns:
        shown = shown.where(text_matches(F.col("text_clean"), search, regex))
    return shown


def agent_facets(tickets: DataFrame) -> DataFrame:
    """``(facet, value, place, chosen)``: the values the agents' filters offer, in their order.

    Priorities by urgency, others after them; those and the complaint types stand in the
    order in which they first occur.  ``chosen`` tells what is selected at first: all but
    the priority ``none``.
    """
    facets = {"priority": "final_priority", "complaint_type": "final_complaint_type"}
    # A row per combination, with the first position of each: few rows are left to sort.
    firsts = tickets.groupBy(*facets.values()).agg(F.min(SEQ).alias("first"))
    pairs = F.inline(F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.col(column).alias("value"), F.col("first"))
        for facet, column in facets.items()
    ]))
    values = firsts.select(pairs).where("value is not null")
    values = values.groupBy("facet", "value").agg(F.min("first").alias("first"))
    urgency = F.array_position(F.lit(list(reversed(PRIORITIES))), F.col("value"))
    known = F.when((F.col("facet") == "priority") & (urgency > 0), urgency).otherwise(len(PRIORITIES) + 1)
    order = Window.partitionBy("facet").orderBy(known, "first")
    placed = values.withColumn("place", F.row_number().over(order).cast("bigint"))
    kept = (F.col("facet") != "priority") | (F.col("value") != "none")
    return placed.select("facet", "value", "place", kept.alias("chosen")).orderBy("facet", "place")


def ticket_page(df: DataFrame, number: int = 1, size: int = 50, chronological: bool = False) -> DataFrame:
    """One page of the queue in its order, with each ticket's ``rank`` in the queue."""
    skipped = (number - 1) * size
    page = order_tickets(df, chronological).offset(skipped).limit(size)
    scored = ["priority_score"] if "final_priority" in df.columns else []
    keys = [*(F.desc(c) for c in scored), *_time_keys(df, chronological)]
    order = Window.orderBy(*keys, "ticket_id", *([SEQ] if SEQ in df.columns else []))
    return page.withColumn("rank", (F.row_number().over(order) + skipped).cast("bigint"))


def _time_keys(df: DataFrame, chronological: bool) -> list[Column]:
    if "created_at" not in df.columns:
        return []
    return [(time_column(df) if chronological else F.col("created_at")).asc_nulls_last()]


def text_matches(c: Column, needle: str, regex: bool = False) -> Column:
    """Case-insensitive search; null never matches."""
    text = F.lower(c)
    found = text.rlike(needle.lower()) if regex else F.contains(text, F.lit(needle.lower()))
    return F.coalesce(found, F.lit(False))


def order_tickets(df: DataFrame, chronological: bool = False) -> DataFrame:
    """Highest priority first, then by time.

    The time is compared as the text it is stored as, or as a time with
    ``chronological``; posts without one come last, and the ticket id breaks
    ties, so the order is total and one hot priority still splits over tasks.
    """
    keys = []
    if "final_priority" in df.columns:
        df = df.withColumn("priority_score", priority_rank(F.col("final_priority")))
        keys.append(F.desc("priority_score"))
    keys += _time_keys(df, chronological)
    return df.orderBy(*keys, "ticket_id", *([SEQ] if SEQ in df.columns else []))


def ticket_table(df: DataFrame) -> DataFrame:
    """The columns of the agents' table, as far as they exist."""
    extra = [c for c in ("priority_score",) if c in df.columns]
    return df.select(*[c for c in TABLE_COLUMNS if c in df.columns], *extra)


def ticket_label(df: DataFrame) -> Column:
    """``time - @author - [type] - « start of the text… »``; missing parts are left out."""
    parts = []
    if "created_at" in df.columns:
        parts.append(F.col("created_at").cast("string"))
    if "screen_name" in df.columns:
        parts.append(F.concat(F.lit("@"), F.col("screen_name")))
    if "final_complaint_type" in df.columns:
        parts.append(F.concat(F.lit("["), F.col("final_complaint_type"), F.lit("]")))
    start = F.substring(F.coalesce(F.col("text_clean"), F.lit("")), 1, LABEL_TEXT_CHARS)
    parts.append(F.concat(F.lit("« "), F.replace(start, F.lit("\n"), F.lit(" ")), F.lit("… »")))
    return F.concat_ws(" - ", *parts)


def ticket_detail(df: DataFrame, ticket_id: str | None = None) -> DataFrame:
    """What an agent sees of a ticket; of one ticket when its id is given."""
    shown = df if ticket_id is None else df.where(F.col("ticket_id") == ticket_id)

    def yes_no(condition: Column) -> Column:
        return F.when(condition, "Oui").otherwise("Non")

    def text(name: str) -> Column:
        column = F.col(name) if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(column, F.lit("N/A")).alias(name)

    def flag(name: str, words: tuple[str, ...]) -> Column:
        column = F.col(name) if name in df.columns else F.lit(False)
        return yes_no(parse_bool(column, words, strip=False)).alias(name)

    return shown.select(
        "ticket_id", text("screen_name"), text("created_at"), text("tweet_type"),
        yes_no(F.col("is_comment")).alias("is_comment"), text("final_complaint_type"),
        text("final_priority"), text("final_sentiment"), flag("final_sarcasm", ("true",)),
        flag("nlp_has_resiliation_risk", TRUE_WORDS_SHORT), text("text_clean"),
        text("llm_explanation"),
    )


def record_status(changes: DataFrame, path: str) -> str:
    """Append status changes ``(ticket_id, status, note)`` to the log at ``path``.

    An unknown status fails the job before anything is committed.
    """
    known = F.col("status").isin(*TICKET_STATUSES)
    refused = F.raise_error(F.concat(F.lit("unknown ticket status: "), F.col("status")))
    entries = changes.select(
        F.col("ticket_id").cast("string").alias("ticket_id"),
        F.current_timestamp().alias("ts"),
        F.monotonically_increasing_id().alias("event_id"),
        F.when(known, F.col("status")).otherwise(refused).alias("status"),
        F.coalesce(F.col("note"), F.lit("")).alias("note"),
        # Two appends may have one time and the same numbers.
        F.lit(uuid.uuid4().hex).alias("batch"),
    )
    entries.write.mode("append").parquet(path)
    return path


ENTRY = "ticket_id string, ts timestamp, event_id bigint, status string, note string, batch string"


def last_entries(log: DataFrame) -> DataFrame:
    """The last entry of each ticket, whole: by time, then by append and place in it."""
    order = [n for n in ("ts", "batch", "event_id") if n in log.columns]
    rest = [c for c in log.columns if c not in order and c != "ticket_id"]
    last = F.max(F.struct(*order, *rest)).alias("_last")
    return log.groupBy("ticket_id").agg(last).select("ticket_id", *[f"_last.{c}" for c in (*order, *rest)])


def latest_status(log: DataFrame) -> DataFrame:
    """The last status and note per ticket from an append-only log."""
    return last_entries(log).select("ticket_id", "status", "note")


def with_status(df: DataFrame, log: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Tickets with their last status and note; new tickets have neither."""
    joined = lookup_join(df, latest_status(log), "ticket_id", spread=SEQ, hot_rows=hot_rows)
    return joined.withColumns({
        "status": F.coalesce(F.col("status"), F.lit(TICKET_STATUSES[0])),
        "note": F.coalesce(F.col("note"), F.lit("")),
    })
