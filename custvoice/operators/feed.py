"""The public feed: posts, replies, embedded originals, threads, pages.

The feed reads raw posts and types them by their references, not by their text
alone, so a post's ``feed_type`` can differ from its ``tweet_type``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvoice.fixed_values import PAGE_SIZES
from custvoice.functions.text import strip_text
from custvoice.functions.values import time_column, with_count_labels
from custvoice.operators.lookup import first_per_key, lookup_join
from custvoice.operators.prepare import is_marked_repost
from custvoice.operators.tickets import text_matches
from custvoice.schema import SEQ
from custvoice.sources.columns import pad_raw

POST_TYPES = ("original", "retweet", "quote")
COUNTERS = {
    "replies": "reply_count", "reposts": "retweet_count", "likes": "favorite_count",
    "views": "views_count",
}
SHOWN = ("id", "feed_type", "created_at", "screen_name", "name", "profile_image_url",
         "display_text")


def reference(c: Column) -> Column:
    """A reference to another post, stripped; null when blank or ``nan``."""
    text = strip_text(c)
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def feed_type(df: DataFrame) -> Column:
    """retweet, quote or reply by the reference set, then by the text's own mark."""
    return (
        F.when(reference(F.col("retweeted_status")).isNotNull(), "retweet")
        .when(reference(F.col("quoted_status")).isNotNull(), "quote")
        .when(reference(F.col("in_reply_to")).isNotNull(), "reply")
        .when(is_marked_repost(df), "retweet")
        .otherwise("original")
    )


def display_text(c: Column) -> Column:
    return F.coalesce(strip_text(c), F.lit(""))


def feed_base(raw: DataFrame) -> DataFrame:
    """Raw posts with all raw columns, ``feed_type, display_text, created_ts, ref_id``.

    ``ref_id`` is the post a retweet or quote embeds.
    """
    padded = pad_raw(raw)
    typed = padded.withColumns({
        "feed_type": feed_type(padded),
        "display_text": display_text(F.col("full_text")),
        "created_ts": time_column(padded),
    })
    ref = F.when(F.col("feed_type") == "retweet", reference(F.col("retweeted_status"))).when(
        F.col("feed_type") == "quote", reference(F.col("quoted_status"))
    )
    return typed.withColumn("ref_id", ref)


def posts_of(feed: DataFrame, kind: str | None = None) -> DataFrame:
    """Posts that are no replies, of one type if ``kind`` is given."""
    return feed.where(F.col("feed_type").isin(*([kind] if kind else POST_TYPES)))


def replies_of(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("feed_type") == "reply")


def search_posts(
    posts: DataFrame, needle: str, kind: str | None = None, regex: bool = False
) -> DataFrame:
    """Posts whose text or author holds the needle, whatever the case."""
    shown = posts_of(posts, kind) if kind else posts
    needle = needle.strip()
    if not needle:
        return shown
    return shown.where(
        text_matches(F.col("full_text"), needle, regex)
        | text_matches(F.col("screen_name"), needle, regex)
    )


def newest_first(posts: DataFrame) -> DataFrame:
    """Newest first; posts without a readable time follow, by falling id."""
    return posts.orderBy(F.desc_nulls_last("created_ts"), F.desc_nulls_last("id"), F.desc(SEQ))


def page_count(posts: DataFrame, size: int = 20) -> DataFrame:
    """One row: posts and pages."""
    counted = posts.agg(F.count(F.lit(1)).alias("posts"))
    pages = F.floor((F.col("posts") + (size - 1)) / size).cast("bigint")
    return counted.withColumn("pages", pages)


def page_of(posts: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page of the feed, newest first, with its ``place`` in the feed.

    Only a page's own rows are numbered.  Spark keeps ``number * size`` rows per
    task for this, so use ``page_after`` for pages deep in a large feed.
    """
    _check_page(number, size)
    skipped = (number - 1) * size
    page = newest_first(posts).offset(skipped).limit(size)
    return _placed(page, skipped)


def page_after(posts: DataFrame, created_at, post_id: str, seq: int, size: int = 20) -> DataFrame:
    """The page that follows a given post: no deeper page costs more than the first.

    ``created_at`` is the last shown post's ``created_ts``, or None.
    """
    _check_page(1, size)
    ts, key, place = F.col("created_ts"), F.col("id"), F.col(SEQ)
    later_id = (key < post_id) | ((key == post_id) & (place < seq))
    if created_at is None:
        later = ts.isNull() & later_id
    else:
        bound = F.lit(created_at)
        later = (ts < bound) | ts.isNull() | ((ts == bound) & later_id)
    return _placed(newest_first(posts.where(later)).limit(size), 0)


def _check_page(number: int, size: int) -> None:
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    if number < 1:
        raise ValueError("pages are numbered from 1")


def _placed(page: DataFrame, skipped: int) -> DataFrame:
    order = Window.orderBy(
        F.desc_nulls_last("created_ts"), F.desc_nulls_last("id"), F.desc(SEQ)
    )
    return page.withColumn("place", (F.row_number().over(order) + skipped).cast("bigint"))


def reply_counts(feed: DataFrame) -> DataFrame:
    """``(id, comments)``: replies per post id, for the ids that have any."""
    return (
        replies_of(feed)
        .groupBy(F.col("in_reply_to").alias("id"))
        .agg(F.count(F.lit(1)).alias("comments"))
    )


def with_reply_counts(
    posts: DataFrame, feed: DataFrame, hot_rows: int | None = None
) -> DataFrame:
    """Posts with their number of replies, 0 if none.

    Replies are counted before the join, so a viral post is one row there.
    """
    joined = lookup_join(posts, reply_counts(feed), "id", spread=SEQ, hot_rows=hot_rows)
    return joined.withColumn("comments", F.coalesce(F.col("comments"), F.lit(0)).cast("bigint"))


ORIGINAL_COLUMNS = ("created_at", "screen_name", "name", "display_text", *COUNTERS.values())


def as_originals(rows: DataFrame) -> DataFrame:
    """Rows as ``orig_*`` columns keyed by ``ref_id``."""
    return rows.select(
        F.col("id").alias("ref_id"),
        F.lit(True).alias("orig_found"),
        *[F.col(c).alias(f"orig_{c}") for c in ORIGINAL_COLUMNS],
    )


def originals(feed: DataFrame, refs: DataFrame) -> DataFrame:
    """The first post, in file order, of each id in ``refs`` (column ``ref_id``).

    Ids and positions alone decide which rows these are; texts and counters are
    fetched for those rows only, by a key that no two rows share.
    """
    firsts = feed.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(SEQ).alias(SEQ))
    wanted = firsts.join(refs.withColumnRenamed("ref_id", "id"), "id", "left_semi")
    return as_originals(feed.join(wanted, ["id", SEQ], "left_semi"))


def with_originals(posts: DataFrame, feed: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Posts with the original that a retweet or quote embeds, if it is known."""
    refs = posts.where(F.col("ref_id").isNotNull()).select("ref_id").distinct()
    return lookup_join(posts, originals(feed, refs), "ref_id", spread=SEQ, hot_rows=hot_rows)


def with_engagement(posts: DataFrame) -> DataFrame:
    """Counter labels: a retweet of a known post shows that post's counters."""
    own = {f"own_{label}": F.col(column) for label, column in COUNTERS.items()}
    embedded = {f"orig_{label}": F.col(f"orig_{column}") for label, column in COUNTERS.items()}
    labelled = with_count_labels(posts, own | embedded)
    found = F.coalesce(F.col("orig_found"), F.lit(False))
    from_original = (F.col("feed_type") == "retweet") & found
    chosen = {
        label: F.when(from_original, F.col(f"orig_{label}")).otherwise(F.col(f"own_{label}"))
        for label in COUNTERS
    } | {f"orig_{label}": F.when(found, F.col(f"orig_{label}")) for label in COUNTERS}
    return labelled.withColumns(chosen).drop(*own)


def timeline(posts: DataFrame, feed: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Posts ready to show: text, embedded original, counters, number of replies."""
    embedded = with_originals(posts, feed, hot_rows)
    return with_reply_counts(with_engagement(embedded), feed, hot_rows)


def timeline_page(
    posts: DataFrame, feed: DataFrame, number: int = 1, size: int = 20
) -> DataFrame:
    """One page ready to show.

    The page is found first.  Its few keys then filter the feed by a broadcast
    (a page has at most 50 rows), so the lookups move no other rows and give at
    most one row per key, which is as small.
    """
    page = page_of(posts, number, size)
    asked = page.select(F.explode(F.array("id", "ref_id")).alias("_key"))
    asked = F.broadcast(asked.where(F.col("_key").isNotNull()).distinct())
    related = feed.join(asked, F.col("id") == F.col("_key"), "left_semi")
    answers = feed.join(asked, F.col("in_reply_to") == F.col("_key"), "left_semi")
    counts = F.broadcast(reply_counts(answers))  # at most one row per post of the page
    known = F.broadcast(as_originals(first_per_key(related, "id", SEQ, list(ORIGINAL_COLUMNS))))
    shown = with_engagement(page.join(known, "ref_id", "left")).join(counts, "id", "left")
    return shown.withColumn("comments", F.coalesce(F.col("comments"), F.lit(0)).cast("bigint"))


def thread(feed: DataFrame, post_id: str) -> DataFrame:
    """The replies to one post, oldest first."""
    answers = replies_of(feed).where(F.col("in_reply_to") == post_id)
    return answers.orderBy(F.asc_nulls_last("created_ts"), SEQ)


def threads(feed: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """All replies to known posts, by post and then oldest first.

    Each reply occurs once, and the sort key ends in the row's own position, so
    a post with very many replies is split over tasks.
    """
    known = posts_of(feed).select(F.col("id").alias("post_id")).distinct()
    answers = replies_of(feed).withColumn("post_id", F.col("in_reply_to"))
    found = lookup_join(answers, known, "post_id", "left_semi", SEQ, hot_rows)
    return found.orderBy("post_id", F.asc_nulls_last("created_ts"), SEQ)
