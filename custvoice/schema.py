"""Declared schemas of the stored stages.  Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

from custvoice.fixed_values import RAW_COLUMNS

# File order of a row.  Set once at ingest, carried through every stage.
SEQ = "_seq"

# Partition column of a stage written by day.
DAY = "created_day"

EXTRA_RAW_COLUMNS = ("in_reply_to_status_id", "is_quote_status")


def _strings(names) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _booleans(names) -> list[T.StructField]:
    return [T.StructField(n, T.BooleanType()) for n in names]


RAW = T.StructType([T.StructField(SEQ, T.LongType())] + _strings(RAW_COLUMNS + EXTRA_RAW_COLUMNS))

PREPARED = T.StructType(
    RAW.fields
    + [T.StructField("created_ts", T.TimestampType())]
    + _strings(["text_clean", "author_type", "tweet_type"])
    + _booleans(["is_about_brand", "keep_for_analysis"])
)

ENRICHED = T.StructType(
    PREPARED.fields
    + [T.StructField("nlp_sentiment_score", T.IntegerType())]
    + _booleans([
        "nlp_probable_complaint", "nlp_has_urgency", "nlp_has_resiliation_risk",
        "nlp_sarcasm_hint",
    ])
    + [T.StructField("nlp_topics_list", T.ArrayType(T.StringType()))]
    + _strings(["nlp_topics", "intent", "complaint_type", "sentiment"])
    + _booleans(["sarcasm"])
    + _strings([
        "priority", "llm_explanation", "final_intent", "final_complaint_type",
        "final_priority", "final_sentiment",
    ])
    + _booleans(["final_sarcasm"])
)
