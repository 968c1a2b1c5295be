"""Every registered query: what it reads, and the operators it runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custvoice import schema
from custvoice.config import DEFAULT
from custvoice.fixed_values import PRIORITIES, RAW_COLUMNS, TRUE_WORDS_SHORT
from custvoice.functions import text as tx
from custvoice.functions import values as vl
from custvoice.operators import classify, cube, dashboard, feed, features, kpis, prepare, tickets
from custvoice.plans import enrichment, feed_stage, incremental, report
from custvoice.session import scratch_dir
from custvoice.sources import columns, posts, split_csv, tables
from custvoice.sources.status_log import StatusLog
from custvoice.streaming import enrich_stream

LEX = DEFAULT.lexicon
SEQ = schema.SEQ

# Days and times are shown as text, so that both engines show them the same way.


def shown_day() -> Column:
    return F.col("day").cast("string").alias("day")


def shown_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- stages -------------------------------------------------------------------

# Paths of the stage tables this session has written, by session, input and stage.
_STAGES: dict[tuple[str, str, str], str] = {}


def _key(spark: SparkSession, sf: str, stage: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, sf, stage


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    """The raw stage: derived posts, ingested once per session."""
    key = _key(spark, sf, "raw")
    if key not in _STAGES:
        ingested = tables.balanced(posts.posts(spark, sf))
        _STAGES[key] = tables.write_stage(ingested, scratch_dir(spark, "raw"))
    return spark.read.parquet(_STAGES[key])


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return posts.stored_answers(spark, sf)


def write_enrichment(spark: SparkSession, sf: str) -> tuple[str, str]:
    """Run the enrichment; paths of the prepared and the enriched stage."""
    root = scratch_dir(spark, "stages")
    prepared, enriched = f"{root}/prepared", f"{root}/enriched"
    stored = answers(spark, sf)
    enrichment.enrich(
        raw_posts(spark, sf), lambda df: classify.classify_stored(df, stored), prepared, enriched
    )
    return prepared, enriched


def stages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The prepared and the enriched stage, written once per session."""
    keys = [_key(spark, sf, stage) for stage in ("prepared", "enriched")]
    if keys[0] not in _STAGES:
        _STAGES.update(zip(keys, write_enrichment(spark, sf)))
    prepared, enriched = (spark.read.parquet(_STAGES[key]) for key in keys)
    return prepared, enriched


def prepared_posts(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.prepare(raw_posts(spark, sf))


def enriched_stage(spark: SparkSession, sf: str) -> DataFrame:
    return stages(spark, sf)[1]


def cube_stage(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard's counts, made once per session: the one scan of posts the panels cost."""
    key = _key(spark, sf, "cube")
    if key not in _STAGES:
        counts = cube.build_cube(enriched_stage(spark, sf))
        _STAGES[key] = tables.write_stage(counts, scratch_dir(spark, "cube"))
    return spark.read.schema(cube.CUBE).parquet(_STAGES[key])


# --- sources ------------------------------------------------------------------

def scan_raw(spark, sf):
    path = scratch_dir(spark, "raw-csv")
    ordered = raw_posts(spark, sf).orderBy(SEQ).drop(SEQ)
    tables.write_stage(ordered, path, "csv")
    return tables.read_raw(spark, path, indexed=True)


def scan_raw_split(spark, sf):
    """The same files, whose texts hold line breaks, read by several tasks each."""
    path = scratch_dir(spark, "raw-csv")
    ordered = raw_posts(spark, sf).orderBy(SEQ).drop(SEQ)
    tables.write_stage(ordered, path, "csv")
    return tables.null_tokens(split_csv.read_csv_split(spark, path, SEQ))


def scan_enriched(spark, sf):
    path = scratch_dir(spark, "enriched-csv")
    tables.write_stage(enriched_stage(spark, sf), path, "csv")
    back = tables.read_enriched(spark, path, "csv")
    return back.select(
        SEQ, "id", "text_clean", "keep_for_analysis", "final_intent", "final_priority",
        "final_sarcasm", F.col("nlp_sentiment_score").cast("bigint").alias("score"),
        "nlp_topics", F.size("nlp_topics_list").cast("bigint").alias("n_topics"),
    )


def pad_columns(spark, sf):
    partial = raw_posts(spark, sf).select(SEQ, "id", "full_text", "screen_name")
    padded = columns.pad_columns(columns.pad_raw(partial), dashboard.COLUMN_DEFAULTS)
    return padded.select(SEQ, *RAW_COLUMNS, *dashboard.COLUMN_DEFAULTS)


def surrogate_key(spark, sf):
    keyless = spark.read.parquet(f"{sf}/documents.parquet")
    return columns.ensure_post_id(keyless).select("doc_id", "id")


# --- cleaning -----------------------------------------------------------------

def _text(expression: Callable[[Column], Column], name: str):
    def query(spark, sf):
        return raw_posts(spark, sf).select(SEQ, expression(F.col("full_text")).alias(name))
    return query


def author_type(spark, sf):
    account = F.col("screen_name")
    return raw_posts(spark, sf).select(
        SEQ, "screen_name", prepare.author_type(account).alias("author_type")
    )


def tweet_type(spark, sf):
    df = raw_posts(spark, sf)
    return df.select(SEQ, prepare.post_type(df).alias("tweet_type"))


def feed_tweet_type(spark, sf):
    return feed_posts_base(spark, sf).select(SEQ, "feed_type", "ref_id")


def is_about_brand(spark, sf):
    text = tx.clean_text(F.col("full_text"))
    return raw_posts(spark, sf).select(SEQ, prepare.is_about_brand(text).alias("is_about_brand"))


def preprocess(spark, sf):
    return prepared_posts(spark, sf).select(
        SEQ, "id", "text_clean", "author_type", "tweet_type", "is_about_brand",
        "keep_for_analysis",
    )


def keep_flag(spark, sf):
    flags = ["author_type", "tweet_type", "is_about_brand", "keep_for_analysis"]
    return prepared_posts(spark, sf).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def format_count(spark, sf):
    counters = ["favorite_count", "retweet_count", "reply_count", "views_count"]
    narrow = raw_posts(spark, sf).select(SEQ, *counters)
    return vl.with_count_labels(narrow, {f"{c}_label": F.col(c) for c in counters})


def parse_created_at(spark, sf):
    df = raw_posts(spark, sf)
    return df.select(SEQ, "created_at", shown_time(vl.time_column(df)).alias("parsed"))


def bool_parse(spark, sf):
    words = ["True", " yes ", "1", "Y", "no", "FALSE", "", "vrai"]
    word = F.element_at(
        F.array(*[F.lit(w) for w in words]), (F.col("event_id") % len(words) + 1).cast("int")
    )
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", word.alias("word"))
    return events.select(
        "event_id", "word",
        vl.parse_bool(F.col("word")).alias("as_flag"),
        vl.parse_bool(F.col("word"), TRUE_WORDS_SHORT).alias("as_short"),
        vl.parse_bool(F.col("word"), ("true",), strip=False).alias("as_true"),
    )


# --- lexical features ---------------------------------------------------------

def _lexical(expression: Callable[[Column], Column], name: str):
    def query(spark, sf):
        clean = tx.clean_text(F.col("full_text"))
        folded = raw_posts(spark, sf).select(SEQ, tx.lexical_text(clean).alias("_lexical"))
        return folded.select(SEQ, expression(F.col("_lexical")).alias(name))
    return query


def contains_any(spark, sf):
    docs = tables.balanced(spark.read.parquet(f"{sf}/documents.parquet"))
    flagged = tx.with_contains_any(docs, "text", {
        "has_fiber": LEX.topics["fiber_issue"], "has_weak_negative": LEX.weak_negative,
    })
    folded = tx.with_contains_any(flagged, "text", {"has_churn_folded": LEX.churn}, fold=True)
    return folded.select("doc_id", "has_fiber", "has_weak_negative", "has_churn_folded")


def topics(spark, sf):
    clean = tx.clean_text(F.col("full_text"))
    folded = raw_posts(spark, sf).select(SEQ, tx.lexical_text(clean).alias("_lexical"))
    named = folded.select(SEQ, features.topics(F.col("_lexical")).alias("_topics"))
    return named.select(
        SEQ, F.concat_ws(",", "_topics").alias("topics"),
        F.size("_topics").cast("bigint").alias("n_topics"),
    )


def probable_complaint(text: Column) -> Column:
    return features.probable_complaint(text, features.sentiment_score(text))


def feature_columns() -> list[Column]:
    flags = [
        "nlp_probable_complaint", "nlp_has_urgency", "nlp_has_resiliation_risk",
        "nlp_sarcasm_hint", "nlp_topics",
    ]
    score = F.col("nlp_sentiment_score").cast("bigint").alias("nlp_sentiment_score")
    return [score, *[F.col(c) for c in flags]]


def nlp_enrich(spark, sf):
    return features.lexical_features(prepared_posts(spark, sf)).select(SEQ, *feature_columns())


def documents_features(spark, sf):
    docs = tables.balanced(spark.read.parquet(f"{sf}/documents.parquet"))
    return features.lexical_features(docs, "text").select("doc_id", *feature_columns())


# --- classification and reconciliation ----------------------------------------

def prompt_column(spark, sf):
    kept = prepared_posts(spark, sf).where("keep_for_analysis")
    return kept.select(SEQ, classify.prompt(F.col("text_clean")).alias("prompt"))


def parse_response(spark, sf):
    stored = posts.stored_answers(spark, sf)
    parsed = classify.with_parsed(stored, F.col("llm_response"))
    return parsed.select(SEQ, *classify.VERDICT_COLUMNS)


def classify_stored(spark, sf):
    prepared = stages(spark, sf)[0]
    verdicts = classify.classify_stored(prepared, answers(spark, sf))
    return verdicts.select(SEQ, "id", "keep_for_analysis", *classify.VERDICT_COLUMNS)


def _stand_in():
    """A fixed rule in the place of a scorer; it fails now and then."""
    import json

    def score(text):
        if "nuit" in text:
            raise RuntimeError("service indisponible")
        kind = "complaint" if "panne" in text.lower() else "other"
        kind = "question" if "?" in text else kind
        return "Voici : " + json.dumps({"intent": kind, "explanation": f"{len(text)} signes"})

    return score


def classify_scored(spark, sf):
    verdicts = classify.classify_scored(stages(spark, sf)[0], _stand_in)
    return verdicts.select(SEQ, "keep_for_analysis", *classify.VERDICT_COLUMNS)


def classify_resumed(spark, sf):
    """The scorer's run over all posts, after one that ended with the posts that ask something."""
    path = scratch_dir(spark, "answers")
    prepared = stages(spark, sf)[0]
    classify.classify_scored(prepared.where(F.contains("text_clean", F.lit("?"))), _stand_in,
                             answers_path=path)
    verdicts = classify.classify_scored(prepared, _stand_in, answers_path=path)
    return verdicts.select(SEQ, "keep_for_analysis", *classify.VERDICT_COLUMNS)


def classify_stream_scored(spark, sf):
    """The scorer on a stream of the prepared posts' source, in micro-batches of two files."""
    raw_posts(spark, sf)
    root = scratch_dir(spark, "scored-stream")
    raw = enrich_stream.read_raw_stream(spark, _STAGES[_key(spark, sf, "raw")], files_per_batch=2)
    running = enrich_stream.write_scored_stream(
        raw, _stand_in, f"{root}/answers", f"{root}/posts", f"{root}/checkpoint", once=True)
    running.awaitTermination()
    scored = enrich_stream.read_scored_stream(spark, f"{root}/posts")
    return scored.select(SEQ, "keep_for_analysis", *classify.VERDICT_COLUMNS)


def limit_scored(spark, sf):
    prepared = stages(spark, sf)[0]
    return classify.cap_kept(prepared, 100).select(SEQ, "keep_for_analysis")


def limit_scored_ties(spark, sf):
    """The cap where seven rows share each position, as after several ingests."""
    shared = stages(spark, sf)[0].withColumn("place", F.expr(f"{SEQ} DIV 7"))
    return classify.cap_kept(shared, 100, order="place", tie=SEQ).select(SEQ, "keep_for_analysis")


FINAL_COLUMNS = (
    "final_intent", "final_complaint_type", "final_priority", "final_sentiment", "final_sarcasm",
)


def reconcile_verdicts(spark, sf):
    prepared = stages(spark, sf)[0]
    verdicts = classify.classify_stored(prepared, answers(spark, sf))
    return enrichment.enrich_columns(verdicts).select(SEQ, *FINAL_COLUMNS)


def bump_priority(spark, sf):
    names = [*PRIORITIES, "urgent"]
    current = F.element_at(
        F.array(*[F.lit(p) for p in names]), (F.col("event_id") % len(names) + 1).cast("int")
    )
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", current.alias("priority"), (F.col("user_id") % 4).alias("steps")
    )
    return events.select(
        "event_id", "priority", "steps",
        vl.bump_priority(F.col("priority"), F.col("steps")).alias("bumped"),
    )


def enriched_posts(spark, sf):
    """The whole job, run afresh: clean, classify, score, reconcile, store, read back."""
    _, enriched = write_enrichment(spark, sf)
    return spark.read.parquet(enriched).select(
        SEQ, "id", "created_at", "screen_name", "text_clean", "author_type", "tweet_type",
        "is_about_brand", "keep_for_analysis", *feature_columns(), *classify.VERDICT_COLUMNS,
        *FINAL_COLUMNS,
    )


def pipeline_from_csv(spark, sf):
    """The job as it is run: from CSV files, with a cap on the posts to classify, stored by day."""
    root = scratch_dir(spark, "job")
    ordered = raw_posts(spark, sf).orderBy(SEQ).drop(SEQ)
    raw = tables.write_stage(ordered, f"{root}/raw", "csv")
    stored = answers(spark, sf)
    job = enrichment.run_enrichment(
        spark, raw, f"{root}/prepared", f"{root}/enriched",
        lambda df: classify.classify_stored(df, stored), limit=300, by_day=True)
    return job.posts.select(
        SEQ, "id", "keep_for_analysis", F.col(schema.DAY).cast("string").alias("day"),
        *classify.VERDICT_COLUMNS, *FINAL_COLUMNS)


def _grown(spark, sf):
    """A version of the conversations' posts, then one with the documents' posts added; once per session."""
    key = _key(spark, sf, "grown")
    root = _STAGES.get(key) or scratch_dir(spark, "grown")
    stored = answers(spark, sf)

    def run():
        return incremental.enrich_new(
            spark, f"{root}/raw", f"{root}/store", lambda df: classify.classify_stored(df, stored),
            classifier_version="stored 1", fmt="parquet")

    if key not in _STAGES:
        place = F.col(SEQ) >= 1_000_000_000_000
        for late in (False, True):
            part = raw_posts(spark, sf).where(place == late).orderBy(SEQ).drop(SEQ)
            tables.write_stage(part, f"{root}/raw", mode="append")
            run()
        _STAGES[key] = root
    return run()


def enriched_incremental(spark, sf):
    """All posts, of which the second run enriched the added files alone."""
    snapshot = _grown(spark, sf)
    return snapshot.posts.select(
        SEQ, "id", "keep_for_analysis", F.lit(len(snapshot.version.segments)).alias("segments"),
        *classify.VERDICT_COLUMNS, *FINAL_COLUMNS)


def cube_incremental(spark, sf):
    """Key figures of both segments, from the counts each brought along."""
    return cube.manager_kpis(cube.filter_posts(_grown(spark, sf).cube))


# --- key figures and report ---------------------------------------------------

def _enriched(operator: Callable[[DataFrame], DataFrame]):
    def query(spark, sf):
        return operator(enriched_stage(spark, sf))
    return query


def kpi_overview(spark, sf):
    df = enriched_stage(spark, sf)
    renamed = df.withColumns({"sentiment": F.col("final_sentiment"),
                              "category": F.col("final_intent")})
    return kpis.overview(renamed)


def sentiment_counts(spark, sf):
    return kpis.value_counts(enriched_stage(spark, sf), "final_sentiment")


def report_metrics(spark, sf):
    prepared, enriched = stages(spark, sf)
    return report.report_metrics(raw_posts(spark, sf), prepared, enriched)


def report_metrics_partial(spark, sf):
    """The report while only the raw posts exist, as it is shown."""
    known = F.coalesce(F.col("value").cast("string"), F.lit(report.NOT_AVAILABLE))
    return report.report_metrics(raw=raw_posts(spark, sf)).withColumn("value", known)


def report_lines(spark, sf):
    return report.report_lines(report_metrics(spark, sf))


# --- dashboard ----------------------------------------------------------------

PERIOD = {"start": date(2024, 1, 3), "end": date(2024, 1, 20)}
CHOSEN_INTENTS = ("complaint", "thanks", "suggestion")
CHOSEN_SENTIMENTS = ("negative", "neutral")
CHOSEN_TYPES = ("network_outage", "billing_issue", "mobile_issue", "equipment_issue")
CHOSEN_PRIORITIES = ("critical", "high", "low")


def dashboard_base(spark, sf):
    return dashboard.dashboard_base(enriched_stage(spark, sf))


def shown_posts(spark, sf):
    return dashboard.filter_posts(dashboard_base(spark, sf))


def chosen_posts(spark, sf):
    return dashboard.filter_posts(
        dashboard_base(spark, sf), **PERIOD, intents=CHOSEN_INTENTS, sentiments=CHOSEN_SENTIMENTS
    )


def _shown(operator: Callable[[DataFrame], DataFrame]):
    def query(spark, sf):
        return operator(shown_posts(spark, sf))
    return query


def shown_counts(spark, sf):
    return cube.filter_posts(cube_stage(spark, sf))


def chosen_counts(spark, sf):
    return cube.filter_posts(
        cube_stage(spark, sf), **PERIOD, intents=CHOSEN_INTENTS, sentiments=CHOSEN_SENTIMENTS
    )


def _counted(operator: Callable[[DataFrame], DataFrame]):
    def query(spark, sf):
        return operator(shown_counts(spark, sf))
    return query


def manager_filtered(spark, sf):
    return chosen_posts(spark, sf).select(
        SEQ, shown_time(F.col("created_ts")).alias("created"), "final_intent", "final_sentiment"
    )


def manager_kpis_filtered(spark, sf):
    return cube.manager_kpis(chosen_counts(spark, sf), CHOSEN_TYPES, CHOSEN_PRIORITIES)


def manager_by_type_filtered(spark, sf):
    shown = cube.filter_complaints(chosen_counts(spark, sf), CHOSEN_TYPES, CHOSEN_PRIORITIES)
    return cube.by_type(shown)


def _complaints(operator: Callable[[DataFrame], DataFrame]):
    def query(spark, sf):
        return operator(cube.filter_complaints(shown_counts(spark, sf)))
    return query


def date_bounds(spark, sf):
    bounds = cube.date_bounds(cube_stage(spark, sf))
    return bounds.select(
        *[F.col(c).cast("string").alias(c) for c in ("first_day", "last_day")], "dated_posts"
    )


def daily_volume(spark, sf):
    return cube.daily_volume(shown_counts(spark, sf)).select(shown_day(), "n")


def daily_negative(spark, sf):
    return cube.daily_negative(shown_counts(spark, sf)).select(shown_day(), "pct_negative")


def daily_error_share(spark, sf):
    """The same trend over the event log, where an error stands for a negative post."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("ts").alias("created_ts"),
        F.when(F.col("event_type") == "error", "negative").otherwise("neutral")
        .alias("final_sentiment"),
    )
    return dashboard.daily_negative(events).select(shown_day(), "pct_negative")


# --- tickets ------------------------------------------------------------------

def open_tickets(spark, sf):
    return tickets.tickets(enriched_stage(spark, sf))


def ticket_queue(spark, sf):
    queue = tickets.ticket_table(tickets.order_tickets(open_tickets(spark, sf)))
    return queue.withColumn("priority_score", F.col("priority_score").cast("bigint"))


def ticket_queue_page(spark, sf):
    """The second page of the queue, as its order has it."""
    page = tickets.ticket_page(open_tickets(spark, sf), number=2, size=20)
    return page.select("rank", SEQ, "ticket_id", "created_at", "final_priority", "screen_name")


def ticket_queue_filtered(spark, sf):
    chosen = tickets.filter_tickets(
        open_tickets(spark, sf), types=CHOSEN_TYPES, comments=False, search="Free"
    )
    return tickets.ticket_table(tickets.order_tickets(chosen, chronological=True)).drop(
        "priority_score"
    )


def ticket_queue_flags(spark, sf):
    chosen = tickets.filter_tickets(
        open_tickets(spark, sf), priorities=(), only_churn_risk=True, comments=False
    )
    mocking = tickets.filter_tickets(open_tickets(spark, sf), (), only_sarcasm=True)
    return chosen.select("ticket_id", F.lit("churn").alias("flag")).unionByName(
        mocking.select("ticket_id", F.lit("sarcasm").alias("flag"))
    )


def ticket_label(spark, sf):
    df = open_tickets(spark, sf)
    return df.select(SEQ, tickets.ticket_label(df).alias("label"))


def ticket_detail(spark, sf):
    return tickets.ticket_detail(open_tickets(spark, sf))


def ticket_status(spark, sf):
    overlaid = tickets.with_status(open_tickets(spark, sf), posts.ticket_log(spark, sf))
    return overlaid.select(SEQ, "ticket_id", "status", "note")


def ticket_status_compacted(spark, sf):
    """Status from a snapshot of the log's first half and the entries after it."""
    log = StatusLog(spark, scratch_dir(spark, "status"))
    entries = posts.ticket_log(spark, sf)
    early = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    log.append(entries.where(early))
    log.compact()
    log.append(entries.where(~early))
    overlaid = tickets.with_status(open_tickets(spark, sf), log.state())
    return overlaid.select(SEQ, "ticket_id", "status", "note")


# --- feed ---------------------------------------------------------------------

def feed_posts_base(spark, sf):
    return feed.feed_base(raw_posts(spark, sf))


def feed_posts(spark, sf):
    shown = feed.posts_of(feed_posts_base(spark, sf))
    return shown.select(SEQ, "id", "feed_type", "display_text")


def feed_replies(spark, sf):
    shown = feed.replies_of(feed_posts_base(spark, sf))
    return shown.select(SEQ, "id", "in_reply_to", "display_text")


def feed_search(spark, sf):
    found = feed.search_posts(feed.posts_of(feed_posts_base(spark, sf)), " Fibre ", "original")
    return found.select(SEQ, "id", "screen_name", "feed_type")


def feed_search_author(spark, sf):
    found = feed.search_posts(feed.posts_of(feed_posts_base(spark, sf)), "CLIENT1")
    return found.select(SEQ, "id", "screen_name", "feed_type")


def feed_page_count(spark, sf):
    return feed.page_count(feed.posts_of(feed_posts_base(spark, sf)), 20)


LABELS = [*feed.COUNTERS, *[f"orig_{c}" for c in feed.COUNTERS]]


def feed_page(spark, sf):
    base = feed_posts_base(spark, sf)
    page = feed.timeline_page(feed.posts_of(base), base, number=2, size=20)
    return page.select(
        "place", SEQ, "id", "feed_type", "screen_name", "display_text", "orig_screen_name",
        *LABELS, "comments",
    )


def feed_embedded(spark, sf):
    base = feed_posts_base(spark, sf)
    shown = feed.with_engagement(feed.with_originals(feed.posts_of(base), base))
    return shown.select(
        SEQ, "id", "feed_type", "ref_id", F.coalesce("orig_found", F.lit(False)).alias("found"),
        "orig_screen_name", "orig_created_at", "orig_display_text", *LABELS,
    )


def feed_timeline(spark, sf):
    """All posts as they are shown: embedded original, counters, number of replies."""
    base = feed_posts_base(spark, sf)
    shown = feed.timeline(feed.posts_of(base), base)
    return shown.select(
        SEQ, "id", "feed_type", "ref_id", F.coalesce("orig_found", F.lit(False)).alias("found"),
        "orig_screen_name", "orig_created_at", "orig_display_text", *LABELS, "comments",
    )


def feed_reply_counts(spark, sf):
    base = feed_posts_base(spark, sf)
    return feed.with_reply_counts(feed.posts_of(base), base).select(SEQ, "id", "comments")


def feed_thread(spark, sf):
    return feed.threads(feed_posts_base(spark, sf)).select(
        "post_id", SEQ, "screen_name", shown_time(F.col("created_ts")).alias("created"),
        "display_text",
    )


def feed_thread_of_post(spark, sf):
    return feed.thread(feed_posts_base(spark, sf), "0").select(SEQ, "id", "screen_name")


def stored_feed(spark, sf) -> feed_stage.Feed:
    """The feed's stage, written once per session."""
    key = _key(spark, sf, "feed")
    if key not in _STAGES:
        path = scratch_dir(spark, "feed")
        feed_stage.write_feed(raw_posts(spark, sf), path, buckets=4)
        _STAGES[key] = path
    return feed_stage.Feed.open(spark, _STAGES[key])


def feed_timeline_stored(spark, sf):
    shown = stored_feed(spark, sf).posts
    return shown.select(
        "place", "kind_place", SEQ, "id", "feed_type", "ref_id",
        F.coalesce("orig_found", F.lit(False)).alias("found"), "orig_screen_name",
        "orig_created_at", "orig_display_text", *LABELS, "comments",
    )


def _page(shown):
    return shown.select(
        "place", SEQ, "id", "feed_type", "screen_name", "display_text", "orig_screen_name",
        *LABELS, "comments",
    )


def feed_page_deep(spark, sf):
    """The last page of the feed."""
    stored = stored_feed(spark, sf)
    return _page(stored.page(stored.page_count(20).first()["pages"], 20))


def feed_page_of_kind(spark, sf):
    """The second page of the retweets."""
    return stored_feed(spark, sf).page(2, 10, "retweet").select("kind_place", SEQ, "id", "comments")


def feed_page_after(spark, sf):
    """The page that follows the fortieth post, found from that post alone."""
    shown = feed.posts_of(feed_posts_base(spark, sf))
    last = feed.page_of(shown, 2, 20).orderBy(F.desc("place")).first()
    page = feed.page_after(shown, last["created_ts"], last["id"], last[SEQ], 20)
    return page.select("place", SEQ, "id", "feed_type", "screen_name")


def feed_search_indexed(spark, sf):
    found = stored_feed(spark, sf).search(" Fibre ", "original")
    return found.select(SEQ, "id", "screen_name", "feed_type")


def feed_search_blocks(spark, sf):
    """A rare needle: what is found, and how few of the blocks are opened."""
    stored = stored_feed(spark, sf)
    found = stored.search("SRC3").join(stored.holding("SRC3"), "block", "left_semi")
    return found.select(SEQ, "id", "screen_name", "feed_type")


def feed_thread_stored(spark, sf):
    return stored_feed(spark, sf).threads().select(
        "post_id", SEQ, "screen_name", shown_time(F.col("created_ts")).alias("created"),
        "display_text",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_raw": scan_raw,
        "scan_raw_split": scan_raw_split,
        "scan_enriched": scan_enriched,
        "pad_columns": pad_columns,
        "surrogate_key": surrogate_key,
        "text_clean": _text(tx.clean_text, "text_clean"),
        "text_clean_strict": _text(lambda c: tx.clean_text(c, strict=True), "text_strict"),
        "author_type": author_type,
        "tweet_type": tweet_type,
        "feed_tweet_type": feed_tweet_type,
        "is_about_brand": is_about_brand,
        "preprocess": preprocess,
        "keep_flag": keep_flag,
        "format_count": format_count,
        "parse_created_at": parse_created_at,
        "bool_parse": bool_parse,
        "text_lexical": _lexical(lambda t: t, "text_lexical"),
        "contains_any": contains_any,
        "sentiment_score": _lexical(
            lambda t: features.sentiment_score(t).cast("bigint"), "score"
        ),
        "topics": topics,
        "probable_complaint": _lexical(probable_complaint, "probable_complaint"),
        "urgency": _lexical(features.has_urgency, "urgency"),
        "churn_risk": _lexical(features.has_churn_risk, "churn_risk"),
        "sarcasm_hint": _lexical(features.sarcasm_hint, "sarcasm_hint"),
        "nlp_enrich": nlp_enrich,
        "documents_features": documents_features,
        "prompt_column": prompt_column,
        "parse_response": parse_response,
        "classify_stored": classify_stored,
        "classify_scored": classify_scored,
        "classify_resumed": classify_resumed,
        "classify_stream_scored": classify_stream_scored,
        "limit_scored": limit_scored,
        "limit_scored_ties": limit_scored_ties,
        "reconcile": reconcile_verdicts,
        "bump_priority": bump_priority,
        "enriched_posts": enriched_posts,
        "pipeline_from_csv": pipeline_from_csv,
        "enriched_incremental": enriched_incremental,
        "kpi_global": _enriched(kpis.global_counts),
        "kpi_by_intent": _enriched(kpis.by_intent),
        "kpi_complaints_by_type": _enriched(kpis.complaints_by_type),
        "kpi_complaints_by_priority": _enriched(kpis.complaints_by_priority),
        "kpi_matrix": _enriched(kpis.intent_type_matrix),
        "kpi_overview": kpi_overview,
        "sentiment_counts": sentiment_counts,
        "report_metrics": report_metrics,
        "report_metrics_partial": report_metrics_partial,
        "report_lines": report_lines,
        "manager_filtered": manager_filtered,
        "manager_kpis": _counted(cube.manager_kpis),
        "manager_kpis_filtered": manager_kpis_filtered,
        "manager_by_intent": _counted(cube.by_intent),
        "manager_by_type": _complaints(cube.by_type),
        "manager_by_type_filtered": manager_by_type_filtered,
        "manager_by_priority": _complaints(cube.by_priority),
        "manager_matrix": _complaints(cube.type_priority_matrix),
        "suggestions_head": _shown(dashboard.suggestions),
        "positive_head": _shown(dashboard.positive_feedback),
        "date_bounds": date_bounds,
        "daily_volume": daily_volume,
        "daily_negative": daily_negative,
        "daily_error_share": daily_error_share,
        "facets": lambda spark, sf: cube.facets(cube_stage(spark, sf)),
        "facets_manager": lambda spark, sf: dashboard.manager_facets(cube_stage(spark, sf)),
        "facets_agent": lambda spark, sf: tickets.agent_facets(open_tickets(spark, sf)),
        "cube_incremental": cube_incremental,
        "ticket_queue": ticket_queue,
        "ticket_queue_page": ticket_queue_page,
        "ticket_queue_filtered": ticket_queue_filtered,
        "ticket_queue_flags": ticket_queue_flags,
        "ticket_label": ticket_label,
        "ticket_detail": ticket_detail,
        "ticket_status": ticket_status,
        "ticket_status_compacted": ticket_status_compacted,
        "feed_posts": feed_posts,
        "feed_replies": feed_replies,
        "feed_search": feed_search,
        "feed_search_author": feed_search_author,
        "feed_page": feed_page,
        "feed_page_count": feed_page_count,
        "feed_embedded": feed_embedded,
        "feed_timeline": feed_timeline,
        "feed_reply_counts": feed_reply_counts,
        "feed_thread": feed_thread,
        "feed_thread_of_post": feed_thread_of_post,
        "feed_timeline_stored": feed_timeline_stored,
        "feed_page_deep": feed_page_deep,
        "feed_page_of_kind": feed_page_of_kind,
        "feed_page_after": feed_page_after,
        "feed_search_indexed": feed_search_indexed,
        "feed_search_blocks": feed_search_blocks,
        "feed_thread_stored": feed_thread_stored,
    }
