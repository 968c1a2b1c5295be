"""Raw posts to prepared posts: clean text, author, post type, brand, keep flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.config import DEFAULT, VoiceConfig
from custvoice.functions.text import any_keyword, clean_text, is_filled
from custvoice.functions.values import TIME, time_column

ANALYSED_TYPES = ("original", "reply", "quote")


def first_present(df: DataFrame, *names: str) -> str:
    """The first of ``names`` the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {names} is present")


def is_official(screen_name: Column, config: VoiceConfig = DEFAULT) -> Column:
    """Exact, case-sensitive account test; null is not official."""
    return F.coalesce(screen_name.isin(*config.official_accounts), F.lit(False))


def author_type(screen_name: Column, config: VoiceConfig = DEFAULT) -> Column:
    return F.when(is_official(screen_name, config), "official").otherwise("customer")


def is_about_brand(text: Column, config: VoiceConfig = DEFAULT) -> Column:
    return F.coalesce(any_keyword(F.lower(text), config.brand_keywords), F.lit(False))


def is_marked_repost(df: DataFrame) -> Column:
    """The text itself says that it repeats another post."""
    if "full_text" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("full_text").startswith("RT "), F.lit(False))


def post_type(df: DataFrame, config: VoiceConfig = DEFAULT) -> Column:
    """retweet, reply, quote or original; the first that applies."""
    kind = F.when(is_marked_repost(df), "retweet")
    if config.reply_column in df.columns:
        kind = kind.when(is_filled(F.col(config.reply_column)), "reply")
    if "is_quote_status" in df.columns:
        kind = kind.when(F.lower(F.col("is_quote_status").cast("string")) == "true", "quote")
    return kind.otherwise("original")


def keep_flag() -> Column:
    """Customer posts about the brand that are no retweets."""
    return (
        (F.col("author_type") == "customer")
        & F.col("tweet_type").isin(*ANALYSED_TYPES)
        & F.col("is_about_brand")
    )


def prepare(df: DataFrame, config: VoiceConfig = DEFAULT) -> DataFrame:
    """Add ``created_ts, text_clean, author_type, tweet_type, is_about_brand, keep_for_analysis``.

    Times are parsed here, once, so that later stages filter on a stored column.
    """
    text = F.col(first_present(df, "full_text", "text"))
    account = F.col(first_present(df, "screen_name", "user_screen_name"))
    cleaned = df.withColumns({
        TIME: time_column(df),
        "text_clean": clean_text(text),
        "author_type": author_type(account, config),
        "tweet_type": post_type(df, config),
    })
    flagged = cleaned.withColumn("is_about_brand", is_about_brand(F.col("text_clean"), config))
    return flagged.withColumn("keep_for_analysis", keep_flag())
