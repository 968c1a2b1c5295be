"""The registered queries restated by hand in SQL, for a second engine to check.

Only inputs are shared with the library: the derived posts, the word lists and
other fixed values, and the prompt text.  All logic is written again here.
"""

from __future__ import annotations

import unicodedata

from custvoice import fixed_values as fixed
from custvoice.operators.classify import NO_ANSWER, NOT_AN_OBJECT, PROMPT_HEAD, PROMPT_TAIL
from custvoice.plans import report
from custvoice.queries import (
    CHOSEN_INTENTS,
    CHOSEN_PRIORITIES,
    CHOSEN_SENTIMENTS,
    CHOSEN_TYPES,
    PERIOD,
)
from custvoice.sources.posts import POSTS_SQL, TICKET_LOG_SQL


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def hits(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def points(text: str, words, weight: int) -> str:
    return " + ".join(
        f"CASE WHEN contains({text}, {lit(w)}) THEN {weight} ELSE 0 END" for w in words
    )


# --- inputs -------------------------------------------------------------------

_TIME = "(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(hours AS INTEGER)))"
_SWAPS = {
    "<string>": "VARCHAR",
    "<time>": f"strftime({_TIME}, '%Y-%m-%d %H:%M:%S')",
    "<tweet_time>": f"strftime({_TIME}, '%a %b %d %H:%M:%S +0000 %Y')",
    "<conversations>": "conversations",
    "<documents>": "documents",
    "<events>": "events",
}


def _duck(statement: str) -> str:
    for mark, text in _SWAPS.items():
        statement = statement.replace(mark, text)
    return statement


POSTS = f"posts AS ({_duck(POSTS_SQL)})"
TICKET_LOG = f"ticket_log AS ({_duck(TICKET_LOG_SQL)})"

# --- expressions --------------------------------------------------------------


def clean(text: str) -> str:
    no_urls = f"regexp_replace(coalesce({text}, ''), 'http[^\\s]+|www\\.[^\\s]+', '', 'g')"
    return f"trim(regexp_replace({no_urls}, '\\s+', ' ', 'g'))"


def strict(text: str) -> str:
    no_urls = f"regexp_replace(coalesce({text}, ''), 'http[^\\s]+|www\\.[^\\s]+', '', 'g')"
    no_tags = f"regexp_replace({no_urls}, '[@#][\\p{{L}}\\p{{M}}\\p{{N}}_]*', '', 'g')"
    return f"lower(trim(regexp_replace({no_tags}, '\\s+', ' ', 'g')))"


def folded(text: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({text}, ''))), '\\s+', ' ', 'g'))"


def filled(c: str) -> str:
    return f"(trim(coalesce({c}, '')) <> '')"


def score(t: str) -> str:
    return (
        f"({points(t, fixed.STRONG_NEGATIVE, 2)} + {points(t, fixed.WEAK_NEGATIVE, 1)} + "
        f"{points(t, fixed.PRAISE, -1)})"
    )


def probable(t: str) -> str:
    return (
        f"({hits(t, fixed.COMPLAINT)} OR {score(t)} >= 2 OR {hits(t, fixed.BREAKDOWN_PHRASES)})"
    )


def topic_list(t: str) -> str:
    cases = ", ".join(
        f"CASE WHEN {hits(t, words)} THEN {lit(name)} END" for name, words in fixed.TOPICS.items()
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def hint(t: str) -> str:
    angry = hits(t, fixed.STRONG_NEGATIVE)
    return (
        f"((contains({t}, 'merci') AND (contains({t}, '...') OR {angry})) "
        f"OR (contains({t}, 'bravo') AND {angry}))"
    )


def rank(p: str) -> str:
    return f"CASE {p} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 " \
           "WHEN 'critical' THEN 4 ELSE 0 END"


def priority(rank_sql: str) -> str:
    return f"(['none', 'low', 'medium', 'high', 'critical'])[least({rank_sql}, 4) + 1]"


def parsed_time(c: str) -> str:
    return (
        f"coalesce(CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d\\d?-\\d\\d?') "
        f"THEN try_cast({c} AS TIMESTAMP) END, "
        f"try_strptime({c}, '%a %b %d %H:%M:%S +0000 %Y'))"
    )


def shown_time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def counter(c: str) -> str:
    number = f"CAST({c} AS BIGINT)"
    return (
        f"CASE WHEN {c} IS NULL OR NOT regexp_matches({c}, '^\\s*[+-]?\\d+\\s*$') THEN '0' "
        f"WHEN {number} >= 1000000 THEN format('{{:.1f}}M', {number}::DOUBLE / 1000000::DOUBLE) "
        f"WHEN {number} >= 1000 THEN format('{{:.1f}}K', {number}::DOUBLE / 1000::DOUBLE) "
        f"ELSE CAST({number} AS VARCHAR) END"
    )


# --- stages -------------------------------------------------------------------

PREPARED = f"""
prepared0 AS (
  SELECT *, {clean("full_text")} AS text_clean,
         CASE WHEN screen_name IN {listed(fixed.OFFICIAL_ACCOUNTS)} THEN 'official'
              ELSE 'customer' END AS author_type,
         CASE WHEN coalesce(full_text, '') LIKE 'RT %' THEN 'retweet'
              WHEN {filled("in_reply_to_status_id")} THEN 'reply'
              WHEN lower(is_quote_status) = 'true' THEN 'quote'
              ELSE 'original' END AS tweet_type
  FROM posts),
prepared1 AS (
  SELECT *, {hits("lower(text_clean)", fixed.BRAND_KEYWORDS)} AS is_about_brand FROM prepared0),
prepared AS (
  SELECT *, author_type = 'customer' AND tweet_type <> 'retweet' AND is_about_brand
         AS keep_for_analysis
  FROM prepared1)"""

LEXICAL = f"""
folded AS (SELECT *, {folded("text_clean")} AS lex FROM prepared),
lexical AS (
  SELECT *, CAST({score("lex")} AS BIGINT) AS nlp_sentiment_score,
         {probable("lex")} AS nlp_probable_complaint,
         {hits("lex", fixed.URGENCY)} AS nlp_has_urgency,
         {hits("lex", fixed.CHURN)} AS nlp_has_resiliation_risk,
         {hint("lex")} AS nlp_sarcasm_hint,
         {topic_list("lex")} AS topic_list
  FROM folded)"""

# The answer's JSON object, if it has one that stands on its own.
ANSWERS = f"""
cut AS (SELECT _seq, id, llm_response AS r,
               regexp_extract(llm_response, '(?s)\\{{.*\\}}', 0) AS body FROM posts),
judged AS (
  SELECT *, CASE WHEN r IS NULL THEN {lit(NO_ANSWER)}
                 WHEN json_valid(r) AND json_type(CASE WHEN json_valid(r) THEN r END) <> 'OBJECT'
                 THEN {lit(NOT_AN_OBJECT)} END AS failure,
         -- This engine's JSON reader lets a trailing comma pass; the format does not.
         CASE WHEN body <> '' AND json_valid(body) AND NOT regexp_matches(body, ',\\s*\\}}')
              THEN body END AS doc
  FROM cut),
parsed AS (
  SELECT _seq, id,
         CASE WHEN failure IS NULL THEN coalesce(doc ->> '$.intent', 'other')
              ELSE 'other' END AS intent,
         CASE WHEN failure IS NULL THEN coalesce(doc ->> '$.complaint_type', 'none')
              ELSE 'none' END AS complaint_type,
         CASE WHEN failure IS NULL THEN coalesce(doc ->> '$.sentiment', 'neutral')
              ELSE 'neutral' END AS sentiment,
         failure IS NULL AND coalesce(lower(doc ->> '$.sarcasm') IN ('true', '1'), false)
             AS sarcasm,
         CASE WHEN failure IS NULL THEN coalesce(doc ->> '$.priority', 'none')
              ELSE 'none' END AS priority,
         CASE WHEN failure IS NOT NULL THEN {lit(fixed.FAILED_CALL)} || failure
              WHEN doc IS NOT NULL THEN coalesce(doc ->> '$.explanation', '')
              ELSE {lit(fixed.UNPARSED_RESPONSE)}
                   || substr(r, 1, {fixed.UNPARSED_RESPONSE_CHARS}) || '...' END
             AS llm_explanation
  FROM judged),
answers AS (
  SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY id ORDER BY _seq) = 1)"""

VERDICTS = """
verdicts AS (
  SELECT l.* EXCLUDE (llm_response),
         CASE WHEN keep_for_analysis THEN a.intent ELSE 'unknown' END AS intent,
         CASE WHEN keep_for_analysis THEN a.complaint_type ELSE 'none' END AS complaint_type,
         CASE WHEN keep_for_analysis THEN a.sentiment ELSE 'neutral' END AS sentiment,
         keep_for_analysis AND a.sarcasm AS sarcasm,
         CASE WHEN keep_for_analysis THEN a.priority ELSE 'none' END AS priority,
         CASE WHEN keep_for_analysis THEN a.llm_explanation ELSE '' END AS llm_explanation
  FROM lexical l LEFT JOIN answers a ON a.id = l.id)"""

ENRICHED = f"""
final0 AS (
  SELECT *, CASE WHEN intent <> 'complaint' AND nlp_probable_complaint
                      AND nlp_sentiment_score >= 2 THEN 'complaint'
                 WHEN intent = 'other' AND nlp_sentiment_score >= 2 THEN 'complaint'
                 ELSE intent END AS final_intent,
         sarcasm OR nlp_sarcasm_hint AS final_sarcasm,
         CASE WHEN nlp_has_resiliation_risk AND {rank("priority")} < 3 THEN 3
              ELSE {rank("priority")} END AS rank0
  FROM verdicts),
enriched AS (
  SELECT *, array_to_string(topic_list, ',') AS nlp_topics,
         CASE WHEN final_intent <> 'complaint' THEN 'none'
              WHEN complaint_type IN ('none', 'other_complaint') AND len(topic_list) > 0
              THEN topic_list[1] ELSE complaint_type END AS final_complaint_type,
         CASE WHEN final_sarcasm AND sentiment = 'positive' THEN 'negative'
              ELSE sentiment END AS final_sentiment,
         CASE WHEN final_intent <> 'complaint' THEN 'none'
              ELSE {priority("rank0 + CAST(nlp_has_urgency AS INTEGER) + "
                             "CAST(nlp_sentiment_score >= 3 AS INTEGER)")} END AS final_priority
  FROM final0)"""

DASHBOARD = f"""
based AS (SELECT *, {parsed_time("created_at")} AS created_ts FROM enriched),
shown AS (SELECT * FROM based WHERE created_ts IS NOT NULL),
chosen AS (
  SELECT * FROM based
  WHERE CAST(created_ts AS DATE) BETWEEN DATE '{PERIOD["start"]}' AND DATE '{PERIOD["end"]}'
    AND final_intent IN {listed(CHOSEN_INTENTS)}
    AND final_sentiment IN {listed(CHOSEN_SENTIMENTS)})"""


def reference(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' AND lower(trim({c})) <> 'nan' THEN trim({c}) END"


_DISPLAY = "regexp_replace(coalesce(full_text, ''), '^\\s+|\\s+$', '', 'g')"
FEED = f"""
refs AS (
  SELECT *, {reference("retweeted_status")} AS rt_ref, {reference("quoted_status")} AS qt_ref,
         {reference("in_reply_to")} AS re_ref, {parsed_time("created_at")} AS created_ts,
         {_DISPLAY} AS display_text
  FROM posts),
feed AS (
  SELECT *, CASE WHEN rt_ref IS NOT NULL THEN rt_ref WHEN qt_ref IS NOT NULL THEN qt_ref END
         AS ref_id,
         CASE WHEN rt_ref IS NOT NULL THEN 'retweet' WHEN qt_ref IS NOT NULL THEN 'quote'
              WHEN re_ref IS NOT NULL THEN 'reply'
              WHEN coalesce(full_text, '') LIKE 'RT %' THEN 'retweet'
              ELSE 'original' END AS feed_type
  FROM refs),
feed_posts AS (SELECT * FROM feed WHERE feed_type <> 'reply'),
first_posts AS (
  SELECT * FROM feed WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY _seq) = 1),
comment_counts AS (
  SELECT in_reply_to AS id, count(*) AS comments FROM feed WHERE feed_type = 'reply' GROUP BY 1)"""

_COUNTERS = {
    "replies": "reply_count", "reposts": "retweet_count", "likes": "favorite_count",
    "views": "views_count",
}
_LABELS = ",\n".join(
    counter(f"CASE WHEN p.feed_type = 'retweet' AND o.id IS NOT NULL THEN o.{column} "
            f"ELSE p.{column} END") + f" AS {label},\n"
    f"CASE WHEN o.id IS NOT NULL THEN {counter(f'o.{column}')} END AS orig_{label}"
    for label, column in _COUNTERS.items()
)

# --- assembly -----------------------------------------------------------------

_STEPS = [POSTS, PREPARED, LEXICAL, ANSWERS, VERDICTS, ENRICHED, DASHBOARD]
_UPTO = {"posts": 1, "prepared": 2, "lexical": 3, "parsed": 4, "verdicts": 5, "enriched": 6,
         "dashboard": 7}


def on(stage: str, select: str, *more: str) -> str:
    """A statement over the chain of stages up to ``stage``."""
    return "WITH " + ",\n".join([*_STEPS[:_UPTO[stage]], *more]) + "\n" + select


def on_feed(select: str) -> str:
    return on("posts", select, FEED)


def counts(source: str, column: str, name: str | None = None, where: str = "TRUE") -> str:
    return (
        f"SELECT {column} AS {name or column}, count(*) AS n FROM {source} "
        f"WHERE {column} IS NOT NULL AND {where} GROUP BY 1"
    )


def pivot(source: str, row: str, column: str, domain, where: str = "TRUE") -> str:
    cells = [
        f"count(CASE WHEN {column} = {lit(v)} AND text_clean <> '' THEN 1 END) AS {v}"
        for v in domain
    ]
    cells.append(
        f"count(CASE WHEN {column} NOT IN {listed(domain)} AND text_clean <> '' THEN 1 END) "
        "AS other_value"
    )
    return (
        f"SELECT {row}, {', '.join(cells)} FROM {source} "
        f"WHERE {row} IS NOT NULL AND {column} IS NOT NULL AND {where} GROUP BY {row}"
    )


# The chain with a cap on the posts to classify, in file order.
CAPPED = """
capped AS (
  SELECT * REPLACE (keep_for_analysis AND row_number() OVER (PARTITION BY keep_for_analysis ORDER BY _seq) <= 300
                    AS keep_for_analysis) FROM prepared)"""


def on_capped(select: str) -> str:
    lexical = LEXICAL.replace("FROM prepared)", "FROM capped)")
    return "WITH " + ",\n".join([POSTS, PREPARED, CAPPED, lexical, ANSWERS, VERDICTS, ENRICHED]) + "\n" + select


FILE_ORDER = "row_number() OVER (ORDER BY _seq) - 1 AS _seq"
COMPLAINT = "final_intent = 'complaint'"
TYPE_DOMAIN = list(dict.fromkeys(fixed.COMPLAINT_TYPES + tuple(fixed.TOPICS)))
URGENCY_ORDER = ["critical", "high", "medium", "low", "none"]
FEATURES = (
    "nlp_sentiment_score, nlp_probable_complaint, nlp_has_urgency, nlp_has_resiliation_risk, "
    "nlp_sarcasm_hint, array_to_string(topic_list, ',') AS nlp_topics"
)
VERDICT = "intent, complaint_type, sentiment, sarcasm, priority, llm_explanation"
FINAL = "final_intent, final_complaint_type, final_priority, final_sentiment, final_sarcasm"
RAW = ", ".join(fixed.RAW_COLUMNS)


def manager_kpis(source: str, urgent: str) -> str:
    return f"""
SELECT count(*) AS total,
       count(*) FILTER ({COMPLAINT}) AS complaints,
       count(*) FILTER (final_intent = 'suggestion') AS suggestions,
       count(*) FILTER (final_intent IN ('thanks', 'praise')) AS positive_feedback,
       count(*) FILTER ({COMPLAINT} AND final_priority IN ('high', 'critical') AND {urgent})
           AS urgent_complaints,
       count(*) FILTER (nlp_has_resiliation_risk) AS churn_risk,
       round(CASE WHEN count(*) = 0 THEN 0.0
             ELSE count(*) FILTER (final_sentiment = 'negative')::DOUBLE / count(*) * 100 END, 6)
           AS pct_negative
FROM {source}"""


def head(intents) -> str:
    return (
        "SELECT _seq, created_at, screen_name, text_clean FROM shown "
        f"WHERE final_intent IN {listed(intents)} ORDER BY _seq LIMIT 20"
    )


def raw_figures() -> dict[str, str]:
    official = f"screen_name IN {listed(fixed.OFFICIAL_ACCOUNTS)}"
    return {
        "total_raw": "SELECT count(*) FROM posts",
        "official_raw": f"SELECT count(*) FROM posts WHERE {official}",
        "official_replies_raw":
            f"SELECT count(*) FROM posts WHERE {official} AND {filled('in_reply_to')}",
    }


def all_figures() -> dict[str, str]:
    official = f"screen_name IN {listed(fixed.OFFICIAL_ACCOUNTS)}"
    kinds = {"retweets": "retweet", "replies": "reply", "quotes": "quote"}
    return raw_figures() | {
        "total_prepared": "SELECT count(*) FROM prepared",
        "total_enriched": "SELECT count(*) FROM enriched",
        "official_prepared": f"SELECT count(*) FROM prepared WHERE {official}",
        "official_enriched": f"SELECT count(*) FROM enriched WHERE {official}",
        **{m: f"SELECT count(*) FROM prepared WHERE tweet_type = {lit(k)}"
           for m, k in kinds.items()},
        "kept": "SELECT count(*) FROM prepared WHERE keep_for_analysis",
        "dropped": "SELECT count(*) FROM prepared WHERE NOT keep_for_analysis",
        "dropped_official": "SELECT count(*) FROM prepared WHERE author_type = 'official'",
        "dropped_retweets": "SELECT count(*) FROM prepared WHERE tweet_type = 'retweet'",
        "dropped_off_brand": "SELECT count(*) FROM prepared WHERE NOT is_about_brand",
        "sarcasm": "SELECT count(*) FROM enriched WHERE final_sarcasm",
        "churn_risk": "SELECT count(*) FROM enriched WHERE nlp_has_resiliation_risk",
    }


def figure_rows(figures: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT 'figures' AS section, {lit(m)} AS metric, CAST(NULL AS VARCHAR) AS key, "
        f"CAST(({sql}) AS BIGINT) AS value" for m, sql in figures.items()
    )


def breakdown_rows() -> str:
    wanted = {
        "by_intent": ("final_intent", "TRUE"), "by_complaint_type":
        ("final_complaint_type", COMPLAINT), "by_priority": ("final_priority", COMPLAINT),
        "by_sentiment": ("final_sentiment", "TRUE"),
    }
    return " UNION ALL ".join(
        f"SELECT 'breakdowns', {lit(m)}, {c}, count(*) FROM enriched WHERE {w} GROUP BY {c}"
        for m, (c, w) in wanted.items()
    )


METRICS = f"metrics AS ({figure_rows(all_figures())} UNION ALL {breakdown_rows()})"
_LAYOUT = ", ".join(
    f"({lit(m)}, {s}, {p}, {lit(label)})"
    for m, (s, p, label) in (report.FIGURES | report.BREAKDOWNS).items()
)
_TITLES = ", ".join(
    [f"(0, {lit('# ' + report.TITLE)})"]
    + [f"({i}, {lit(f'## {i}. {title}')})" for i, title in enumerate(report.SECTIONS, 1)]
)
REPORT = f"""
SELECT row_number() OVER (ORDER BY part, place, level, weight, name) AS line_no, line FROM (
  SELECT part, place, CASE WHEN section = 'figures' THEN 0 ELSE 2 END AS level,
         -coalesce(value, 0) AS weight, coalesce(key, label) AS name,
         '- ' || coalesce(key, label) || ' : **' || coalesce(CAST(value AS VARCHAR), 'N/A')
         || '**' AS line
  FROM metrics JOIN (VALUES {_LAYOUT}) l(metric, part, place, label) USING (metric)
  UNION ALL
  SELECT DISTINCT part, place, 1, 0, label, '### ' || label
  FROM metrics JOIN (VALUES {_LAYOUT}) l(metric, part, place, label) USING (metric)
  WHERE section = 'breakdowns'
  UNION ALL
  SELECT part, 0, 0, 0, '', line FROM (VALUES {_TITLES}) t(part, line))"""


_WORDS = ["True", " yes ", "1", "Y", "no", "FALSE", "", "vrai"]
_BUMPED = [*fixed.PRIORITIES, "urgent"]
FOLDED_CHURN = [
    "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))
    for w in fixed.CHURN
]
TICKETS = "tickets AS (SELECT *, id AS ticket_id, tweet_type = 'reply' AS is_comment " \
          f"FROM enriched WHERE {COMPLAINT})"
TICKET_COLUMNS = (
    "ticket_id, created_at, screen_name, text_clean, final_complaint_type, final_priority, "
    "final_sentiment, final_sarcasm, is_comment"
)


def null_tokens(c: str) -> str:
    return f"CASE WHEN {c} IN {listed(fixed.CSV_NULL_TOKENS)} THEN NULL ELSE {c} END AS {c}"


def yes_no(c: str, name: str) -> str:
    return f"CASE WHEN {c} THEN 'Oui' ELSE 'Non' END AS {name}"


def oracle_sql() -> dict[str, str]:
    raw_all = [*fixed.RAW_COLUMNS, "in_reply_to_status_id", "is_quote_status"]
    narrow_type = f"final_complaint_type IN {listed(CHOSEN_TYPES)}"
    narrow = f"{narrow_type} AND final_priority IN {listed(CHOSEN_PRIORITIES)}"
    missing = [c for c in fixed.RAW_COLUMNS if c not in ("id", "full_text", "screen_name")]
    partial = raw_figures() | {
        m: f"SELECT count(*) FROM posts WHERE {filled(c)}" for m, c in {
            "retweets": "retweeted_status", "replies": "in_reply_to", "quotes": "quoted_status",
        }.items()
    } | {m: "0" for m in ("total_prepared", "total_enriched", "official_prepared",
                          "official_enriched")}
    partial |= {m: "NULL" for m in report.FIGURES if m not in partial}
    return {
        "scan_raw": on("posts", "SELECT row_number() OVER (ORDER BY _seq) - 1 AS _seq, "
                       + ", ".join(null_tokens(c) for c in raw_all) + " FROM posts"),
        "scan_raw_split": on("posts", "SELECT row_number() OVER (ORDER BY _seq) - 1 AS _seq, "
                             + ", ".join(null_tokens(c) for c in raw_all) + " FROM posts"),
        "scan_enriched": on("enriched", "SELECT _seq, id, nullif(text_clean, '') AS text_clean, "
                            "keep_for_analysis, final_intent, final_priority, final_sarcasm, "
                            "nlp_sentiment_score AS score, nullif(nlp_topics, '') AS nlp_topics, "
                            "len(topic_list) AS n_topics FROM enriched"),
        "pad_columns": on("posts", "SELECT _seq, id, full_text, screen_name, "
                          + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in missing)
                          + ", 'other' AS final_intent, 'none' AS final_complaint_type, "
                          "'none' AS final_priority, 'neutral' AS final_sentiment, "
                          "false AS final_sarcasm, false AS nlp_has_resiliation_risk FROM posts"),
        "surrogate_key": "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) "
                         "AS id FROM documents",
        "text_clean": on("prepared", "SELECT _seq, text_clean FROM prepared"),
        "text_clean_strict": on("posts", f"SELECT _seq, {strict('full_text')} AS text_strict "
                                "FROM posts"),
        "author_type": on("prepared", "SELECT _seq, screen_name, author_type FROM prepared"),
        "tweet_type": on("prepared", "SELECT _seq, tweet_type FROM prepared"),
        "feed_tweet_type": on_feed("SELECT _seq, feed_type, ref_id FROM feed"),
        "is_about_brand": on("prepared", "SELECT _seq, is_about_brand FROM prepared"),
        "preprocess": on("prepared", "SELECT _seq, id, text_clean, author_type, tweet_type, "
                         "is_about_brand, keep_for_analysis FROM prepared"),
        "keep_flag": on("prepared", "SELECT author_type, tweet_type, is_about_brand, "
                        "keep_for_analysis, count(*) AS n FROM prepared GROUP BY ALL"),
        "format_count": on("posts", "SELECT _seq, " + ", ".join(
            f"{c}, {counter(c)} AS {c}_label"
            for c in ("favorite_count", "retweet_count", "reply_count", "views_count")
        ) + " FROM posts"),
        "parse_created_at": on("posts", "SELECT _seq, created_at, "
                               f"{shown_time(parsed_time('created_at'))} AS parsed FROM posts"),
        "bool_parse": f"""
SELECT event_id, word, lower(trim(word)) IN ('true', '1', 'yes', 'y') AS as_flag,
       lower(trim(word)) IN ('true', '1') AS as_short, lower(word) = 'true' AS as_true
FROM (SELECT event_id, ([{", ".join(lit(w) for w in _WORDS)}])[event_id % 8 + 1] AS word
      FROM events)""",
        "text_lexical": on("lexical", "SELECT _seq, lex AS text_lexical FROM lexical"),
        "contains_any": f"""
SELECT doc_id, {hits("t", fixed.TOPICS["fiber_issue"])} AS has_fiber,
       {hits("t", fixed.WEAK_NEGATIVE)} AS has_weak_negative,
       {hits("t", FOLDED_CHURN)} AS has_churn_folded
FROM (SELECT doc_id, {folded("text")} AS t FROM documents)""",
        "sentiment_score": on("lexical", "SELECT _seq, nlp_sentiment_score AS score FROM lexical"),
        "topics": on("lexical", "SELECT _seq, array_to_string(topic_list, ',') AS topics, "
                     "len(topic_list) AS n_topics FROM lexical"),
        "probable_complaint": on("lexical", "SELECT _seq, nlp_probable_complaint AS "
                                 "probable_complaint FROM lexical"),
        "urgency": on("lexical", "SELECT _seq, nlp_has_urgency AS urgency FROM lexical"),
        "churn_risk": on("lexical", "SELECT _seq, nlp_has_resiliation_risk AS churn_risk "
                         "FROM lexical"),
        "sarcasm_hint": on("lexical", "SELECT _seq, nlp_sarcasm_hint AS sarcasm_hint "
                           "FROM lexical"),
        "nlp_enrich": on("lexical", f"SELECT _seq, {FEATURES} FROM lexical"),
        "documents_features": "WITH prepared AS (SELECT doc_id, text AS text_clean "
                              f"FROM documents), {LEXICAL} SELECT doc_id, {FEATURES} FROM lexical",
        "prompt_column": on("prepared", f"SELECT _seq, {lit(PROMPT_HEAD)} || text_clean || "
                            f"{lit(PROMPT_TAIL)} AS prompt FROM prepared "
                            "WHERE keep_for_analysis"),
        "parse_response": on("parsed", f"SELECT _seq, {VERDICT} FROM parsed"),
        "classify_stored": on("verdicts", f"SELECT _seq, id, keep_for_analysis, {VERDICT} "
                              "FROM verdicts"),
        "classify_scored": on("prepared", f"""
SELECT _seq, keep_for_analysis,
       CASE WHEN NOT keep_for_analysis THEN 'unknown' WHEN contains(text_clean, 'nuit') THEN 'other'
            WHEN contains(text_clean, '?') THEN 'question'
            WHEN contains(lower(text_clean), 'panne') THEN 'complaint' ELSE 'other' END AS intent,
       'none' AS complaint_type, 'neutral' AS sentiment, false AS sarcasm, 'none' AS priority,
       CASE WHEN NOT keep_for_analysis THEN ''
            WHEN contains(text_clean, 'nuit') THEN {lit(fixed.FAILED_CALL)} || 'service indisponible'
            ELSE length(text_clean) || ' signes' END AS llm_explanation
FROM prepared"""),
        "classify_resumed": on("prepared", f"""
SELECT _seq, keep_for_analysis,
       CASE WHEN NOT keep_for_analysis THEN 'unknown' WHEN contains(text_clean, 'nuit') THEN 'other'
            WHEN contains(text_clean, '?') THEN 'question'
            WHEN contains(lower(text_clean), 'panne') THEN 'complaint' ELSE 'other' END AS intent,
       'none' AS complaint_type, 'neutral' AS sentiment, false AS sarcasm, 'none' AS priority,
       CASE WHEN NOT keep_for_analysis THEN ''
            WHEN contains(text_clean, 'nuit') THEN {lit(fixed.FAILED_CALL)} || 'service indisponible'
            ELSE length(text_clean) || ' signes' END AS llm_explanation
FROM prepared"""),
        "classify_stream_scored": on("prepared", f"""
SELECT _seq, keep_for_analysis,
       CASE WHEN NOT keep_for_analysis THEN 'unknown' WHEN contains(text_clean, 'nuit') THEN 'other'
            WHEN contains(text_clean, '?') THEN 'question'
            WHEN contains(lower(text_clean), 'panne') THEN 'complaint' ELSE 'other' END AS intent,
       'none' AS complaint_type, 'neutral' AS sentiment, false AS sarcasm, 'none' AS priority,
       CASE WHEN NOT keep_for_analysis THEN ''
            WHEN contains(text_clean, 'nuit') THEN {lit(fixed.FAILED_CALL)} || 'service indisponible'
            ELSE length(text_clean) || ' signes' END AS llm_explanation
FROM prepared"""),
        "limit_scored": on("prepared", """
SELECT _seq, keep_for_analysis AND
       row_number() OVER (PARTITION BY keep_for_analysis ORDER BY _seq) <= 100
       AS keep_for_analysis FROM prepared"""),
        "limit_scored_ties": on("prepared", """
SELECT _seq, keep_for_analysis AND
       row_number() OVER (PARTITION BY keep_for_analysis ORDER BY _seq // 7, _seq) <= 100
       AS keep_for_analysis FROM prepared"""),
        "reconcile": on("enriched", f"SELECT _seq, {FINAL} FROM enriched"),
        "bump_priority": f"""
SELECT event_id, priority, steps, {priority(f"({rank('priority')}) + steps")} AS bumped
FROM (SELECT event_id, ([{", ".join(lit(p) for p in _BUMPED)}])[event_id % 6 + 1] AS priority,
             user_id % 4 AS steps FROM events)""",
        "enriched_posts": on("enriched", "SELECT _seq, id, created_at, screen_name, text_clean, "
                             "author_type, tweet_type, is_about_brand, keep_for_analysis, "
                             f"{FEATURES}, {VERDICT}, {FINAL} FROM enriched"),
        "pipeline_from_csv": on_capped(
            f"SELECT {FILE_ORDER}, id, keep_for_analysis, CAST(CAST({parsed_time('created_at')} "
            f"AS DATE) AS VARCHAR) AS day, {VERDICT}, {FINAL} FROM enriched"),
        "enriched_incremental": on("enriched", f"SELECT {FILE_ORDER}, id, keep_for_analysis, "
                                   f"2 AS segments, {VERDICT}, {FINAL} FROM enriched"),
        "cube_incremental": on("dashboard", manager_kpis("shown", "TRUE")),
        "kpi_global": on("enriched", "SELECT count(*) AS total_posts, CAST(NULL AS BIGINT) AS "
                         f"kept_for_analysis, count(*) FILTER ({COMPLAINT}) AS complaints_final "
                         "FROM enriched"),
        "kpi_by_intent": on("enriched", counts("enriched", "final_intent")),
        "kpi_complaints_by_type": on(
            "enriched", counts("enriched", "final_complaint_type", where=COMPLAINT)),
        "kpi_complaints_by_priority": on(
            "enriched", counts("enriched", "final_priority", where=COMPLAINT)),
        "kpi_matrix": on("enriched", pivot("enriched", "final_intent", "final_complaint_type",
                                           TYPE_DOMAIN)),
        "kpi_overview": on("enriched", """
SELECT 'global' AS section, 'total' AS key, count(*) AS n FROM enriched
UNION ALL SELECT 'global', 'kept', count(*) FROM enriched WHERE keep_for_analysis
UNION ALL SELECT 'structure', CASE tweet_type WHEN 'retweet' THEN 'retweets' ELSE 'quotes' END,
          count(*) FROM enriched WHERE tweet_type IN ('retweet', 'quote') GROUP BY 2
UNION ALL SELECT 'sentiments', final_sentiment, count(*) FROM enriched GROUP BY 2
UNION ALL SELECT 'categories', final_intent, count(*) FROM enriched GROUP BY 2"""),
        "sentiment_counts": on("enriched", counts("enriched", "final_sentiment")),
        "report_metrics": on("enriched", "SELECT * FROM metrics", METRICS),
        "report_metrics_partial": on("posts", "SELECT section, metric, key, "
                                     "coalesce(CAST(value AS VARCHAR), 'N/A') AS value "
                                     f"FROM ({figure_rows(partial)})"),
        "report_lines": on("enriched", REPORT, METRICS),
        "manager_filtered": on("dashboard", f"SELECT _seq, {shown_time('created_ts')} AS created, "
                               "final_intent, final_sentiment FROM chosen"),
        "manager_kpis": on("dashboard", manager_kpis("shown", "TRUE")),
        "manager_kpis_filtered": on("dashboard", manager_kpis("chosen", narrow)),
        "manager_by_intent": on("dashboard", counts("shown", "final_intent", "intent")),
        "manager_by_type": on("dashboard", counts("shown", "final_complaint_type",
                                                  "complaint_type", COMPLAINT)),
        "manager_by_type_filtered": on("dashboard", counts(
            "chosen", "final_complaint_type", "complaint_type", f"{COMPLAINT} AND {narrow}")),
        "manager_by_priority": on("dashboard", counts(
            "shown", "final_priority", "priority",
            f"{COMPLAINT} AND final_priority IN {listed(URGENCY_ORDER)}")),
        "manager_matrix": on("dashboard", pivot("shown", "final_complaint_type", "final_priority",
                                                URGENCY_ORDER, COMPLAINT)),
        "suggestions_head": on("dashboard", head(["suggestion"])),
        "positive_head": on("dashboard", head(["thanks", "praise"])),
        "date_bounds": on("dashboard", "SELECT CAST(CAST(min(created_ts) AS DATE) AS VARCHAR) AS "
                          "first_day, CAST(CAST(max(created_ts) AS DATE) AS VARCHAR) AS last_day, "
                          "count(created_ts) AS dated_posts FROM based"),
        "daily_volume": on("dashboard", "SELECT CAST(CAST(created_ts AS DATE) AS VARCHAR) AS day, "
                           "count(nullif(text_clean, '')) AS n FROM shown GROUP BY 1"),
        "daily_negative": on("dashboard", "SELECT CAST(CAST(created_ts AS DATE) AS VARCHAR) AS "
                             "day, round(avg(CASE WHEN final_sentiment = 'negative' THEN 1.0 ELSE "
                             "0.0 END) * 100, 6) AS pct_negative FROM shown GROUP BY 1"),
        "daily_error_share": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(CASE "
                             "WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) * 100, 6) AS "
                             "pct_negative FROM events GROUP BY 1",
        "facets": on("enriched", """
SELECT DISTINCT facet, value,
       CASE WHEN facet = 'priority' THEN CASE value WHEN 'critical' THEN 1 WHEN 'high' THEN 2
            WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'none' THEN 5 ELSE 6 END
            ELSE 0 END::BIGINT AS place
FROM (SELECT 'intent' AS facet, final_intent AS value FROM enriched
      UNION ALL SELECT 'complaint_type', final_complaint_type FROM enriched
      UNION ALL SELECT 'priority', final_priority FROM enriched
      UNION ALL SELECT 'sentiment', final_sentiment FROM enriched)
WHERE value IS NOT NULL"""),
        "facets_manager": on("enriched", """
SELECT DISTINCT facet, value,
       CASE WHEN facet = 'priority' THEN CASE value WHEN 'critical' THEN 1 WHEN 'high' THEN 2
            WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'none' THEN 5 ELSE 6 END
            ELSE 0 END::BIGINT AS place
FROM (SELECT 'intent' AS facet, final_intent AS value FROM enriched
      UNION ALL SELECT 'complaint_type', final_complaint_type FROM enriched
      UNION ALL SELECT 'priority', final_priority FROM enriched
      UNION ALL SELECT 'sentiment', final_sentiment FROM enriched)
WHERE value IS NOT NULL AND (facet <> 'priority' OR value IN ('critical', 'high', 'medium', 'low', 'none')
      OR NOT EXISTS (FROM enriched WHERE final_priority IN ('critical', 'high', 'medium', 'low', 'none')))"""),
        "facets_agent": on("enriched", """
SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY known, first) AS place,
       facet <> 'priority' OR value <> 'none' AS chosen
FROM (SELECT facet, value, min(_seq) AS first, CASE WHEN facet <> 'priority' THEN 6 ELSE CASE value
             WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4
             WHEN 'none' THEN 5 ELSE 6 END END AS known
      FROM (SELECT 'priority' AS facet, final_priority AS value, _seq FROM tickets
            UNION ALL SELECT 'complaint_type', final_complaint_type, _seq FROM tickets)
      WHERE value IS NOT NULL GROUP BY ALL)""", TICKETS),
        "ticket_queue_page": on("enriched", f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY {rank('final_priority')} DESC, created_at ASC NULLS LAST, ticket_id, _seq) AS rank,
                      _seq, ticket_id, created_at, final_priority, screen_name FROM tickets)
WHERE rank BETWEEN 21 AND 40""", TICKETS),
        "ticket_queue": on("enriched", f"SELECT {TICKET_COLUMNS}, "
                           f"CAST({rank('final_priority')} AS BIGINT) AS priority_score "
                           "FROM tickets", TICKETS),
        "ticket_queue_filtered": on("enriched", f"SELECT {TICKET_COLUMNS} FROM tickets WHERE "
                                    f"final_priority <> 'none' AND {narrow_type} AND NOT "
                                    "is_comment AND contains(lower(text_clean), 'free')", TICKETS),
        "ticket_queue_flags": on("enriched", "SELECT ticket_id, 'churn' AS flag FROM tickets "
                                 "WHERE nlp_has_resiliation_risk AND NOT is_comment UNION ALL "
                                 "SELECT ticket_id, 'sarcasm' FROM tickets WHERE final_sarcasm",
                                 TICKETS),
        "ticket_label": on("enriched", "SELECT _seq, created_at || ' - @' || screen_name || ' - ["
                           "' || final_complaint_type || '] - « ' || replace(substr(text_clean, "
                           "1, 80), chr(10), ' ') || '… »' AS label FROM tickets", TICKETS),
        "ticket_detail": on("enriched", "SELECT ticket_id, screen_name, created_at, tweet_type, "
                            + yes_no("is_comment", "is_comment")
                            + ", final_complaint_type, final_priority, final_sentiment, "
                            + yes_no("final_sarcasm", "final_sarcasm") + ", "
                            + yes_no("nlp_has_resiliation_risk", "nlp_has_resiliation_risk")
                            + ", text_clean, llm_explanation FROM tickets", TICKETS),
        "ticket_status": on("enriched", """
SELECT t._seq, t.ticket_id, coalesce(s.status, 'Nouveau') AS status, coalesce(s.note, '') AS note
FROM tickets t LEFT JOIN (
  SELECT * FROM ticket_log
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY ts DESC, event_id DESC) = 1) s
ON s.ticket_id = t.ticket_id""", TICKETS, TICKET_LOG),
        "ticket_status_compacted": on("enriched", """
SELECT t._seq, t.ticket_id, coalesce(s.status, 'Nouveau') AS status, coalesce(s.note, '') AS note
FROM tickets t LEFT JOIN (
  SELECT * FROM ticket_log
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY ts DESC, event_id DESC) = 1) s
ON s.ticket_id = t.ticket_id""", TICKETS, TICKET_LOG),
        "feed_posts": on_feed("SELECT _seq, id, feed_type, display_text FROM feed_posts"),
        "feed_replies": on_feed("SELECT _seq, id, in_reply_to, display_text FROM feed "
                                "WHERE feed_type = 'reply'"),
        "feed_search": on_feed("SELECT _seq, id, screen_name, feed_type FROM feed_posts WHERE "
                               "feed_type = 'original' AND (contains(lower(full_text), 'fibre') "
                               "OR contains(lower(screen_name), 'fibre'))"),
        "feed_search_author": on_feed("SELECT _seq, id, screen_name, feed_type FROM feed_posts "
                                      "WHERE contains(lower(full_text), 'client1') OR "
                                      "contains(lower(screen_name), 'client1')"),
        "feed_page": on_feed(f"""
SELECT p.place, p._seq, p.id, p.feed_type, p.screen_name, p.display_text,
       o.screen_name AS orig_screen_name, {_LABELS}, coalesce(c.comments, 0) AS comments
FROM (SELECT *, row_number() OVER (ORDER BY created_ts DESC NULLS LAST, id DESC, _seq DESC)
             AS place FROM feed_posts) p
LEFT JOIN first_posts o ON o.id = p.ref_id LEFT JOIN comment_counts c ON c.id = p.id
WHERE place BETWEEN 21 AND 40"""),
        "feed_page_deep": on_feed(f"""
SELECT p.place, p._seq, p.id, p.feed_type, p.screen_name, p.display_text,
       o.screen_name AS orig_screen_name, {_LABELS}, coalesce(c.comments, 0) AS comments
FROM (SELECT *, row_number() OVER (ORDER BY created_ts DESC NULLS LAST, id DESC, _seq DESC)
             AS place FROM feed_posts) p
LEFT JOIN first_posts o ON o.id = p.ref_id LEFT JOIN comment_counts c ON c.id = p.id
WHERE place > ((SELECT count(*) FROM feed_posts) - 1) // 20 * 20"""),
        "feed_page_of_kind": on_feed("""
SELECT kind_place, _seq, p.id, coalesce(c.comments, 0) AS comments
FROM (SELECT *, row_number() OVER (ORDER BY created_ts DESC NULLS LAST, id DESC, _seq DESC)
             AS kind_place FROM feed_posts WHERE feed_type = 'retweet') p
LEFT JOIN comment_counts c ON c.id = p.id WHERE kind_place BETWEEN 11 AND 20"""),
        "feed_page_after": on_feed("""
SELECT place - 40 AS place, _seq, id, feed_type, screen_name
FROM (SELECT *, row_number() OVER (ORDER BY created_ts DESC NULLS LAST, id DESC, _seq DESC) AS place FROM feed_posts) WHERE place BETWEEN 41 AND 60"""),
        "feed_search_indexed": on_feed("SELECT _seq, id, screen_name, feed_type FROM feed_posts WHERE "
                                       "feed_type = 'original' AND (contains(lower(full_text), 'fibre') "
                                       "OR contains(lower(screen_name), 'fibre'))"),
        "feed_search_blocks": on_feed("SELECT _seq, id, screen_name, feed_type FROM feed_posts WHERE "
                                      "contains(lower(full_text), 'src3') OR "
                                      "contains(lower(screen_name), 'src3')"),
        "feed_timeline_stored": on_feed(f"""
SELECT row_number() OVER (ORDER BY p.created_ts DESC NULLS LAST, p.id DESC, p._seq DESC) AS place,
       row_number() OVER (PARTITION BY p.feed_type ORDER BY p.created_ts DESC NULLS LAST, p.id DESC, p._seq DESC) AS kind_place,
       p._seq, p.id, p.feed_type, p.ref_id, o.id IS NOT NULL AS found,
       o.screen_name AS orig_screen_name, o.created_at AS orig_created_at,
       o.display_text AS orig_display_text, {_LABELS}, coalesce(c.comments, 0) AS comments
FROM feed_posts p LEFT JOIN first_posts o ON o.id = p.ref_id
LEFT JOIN comment_counts c ON c.id = p.id"""),
        "feed_page_count": on_feed("SELECT count(*) AS posts, (count(*) + 19) // 20 AS pages "
                                   "FROM feed_posts"),
        "feed_embedded": on_feed(f"""
SELECT p._seq, p.id, p.feed_type, p.ref_id, o.id IS NOT NULL AS found,
       o.screen_name AS orig_screen_name, o.created_at AS orig_created_at,
       o.display_text AS orig_display_text, {_LABELS}
FROM feed_posts p LEFT JOIN first_posts o ON o.id = p.ref_id"""),
        "feed_timeline": on_feed(f"""
SELECT p._seq, p.id, p.feed_type, p.ref_id, o.id IS NOT NULL AS found,
       o.screen_name AS orig_screen_name, o.created_at AS orig_created_at,
       o.display_text AS orig_display_text, {_LABELS}, coalesce(c.comments, 0) AS comments
FROM feed_posts p LEFT JOIN first_posts o ON o.id = p.ref_id
LEFT JOIN comment_counts c ON c.id = p.id"""),
        "feed_reply_counts": on_feed("SELECT p._seq, p.id, coalesce(c.comments, 0) AS comments "
                                     "FROM feed_posts p LEFT JOIN comment_counts c "
                                     "ON c.id = p.id"),
        "feed_thread": on_feed("SELECT in_reply_to AS post_id, _seq, screen_name, "
                               f"{shown_time('created_ts')} AS created, display_text FROM feed "
                               "WHERE feed_type = 'reply' AND in_reply_to IN "
                               "(SELECT id FROM feed_posts)"),
        "feed_thread_stored": on_feed("SELECT in_reply_to AS post_id, _seq, screen_name, "
                               f"{shown_time('created_ts')} AS created, display_text FROM feed "
                               "WHERE feed_type = 'reply' AND in_reply_to IN "
                               "(SELECT id FROM feed_posts)"),
        "feed_thread_of_post": on_feed("SELECT _seq, id, screen_name FROM feed "
                                       "WHERE feed_type = 'reply' AND in_reply_to = '0'"),
    }
