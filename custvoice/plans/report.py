"""The analyst's report: figures of all stages, and the same as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvoice.config import DEFAULT, VoiceConfig
from custvoice.fixed_values import TRUE_WORDS_SHORT
from custvoice.functions.text import is_filled
from custvoice.functions.values import parse_bool
from custvoice.operators.kpis import count_if, counts_in_one_pass, has_columns
from custvoice.operators.prepare import is_official
from custvoice.sources.columns import literal_rows

# metric -> (section, place in the section, label)
FIGURES = {
    "total_raw": (1, 1, "Messages bruts"),
    "total_prepared": (1, 2, "Messages préparés"),
    "total_enriched": (1, 3, "Messages enrichis"),
    "official_raw": (2, 1, "Messages des comptes officiels, table brute"),
    "official_prepared": (2, 2, "Messages des comptes officiels, table préparée"),
    "official_enriched": (2, 3, "Messages des comptes officiels, table enrichie"),
    "official_replies_raw": (2, 4, "Réponses des comptes officiels"),
    "retweets": (3, 1, "Partages"),
    "replies": (3, 2, "Réponses"),
    "quotes": (3, 3, "Citations"),
    "kept": (4, 1, "Messages retenus"),
    "dropped": (4, 2, "Messages écartés"),
    "dropped_official": (4, 3, "dont auteur officiel"),
    "dropped_retweets": (4, 4, "dont partages"),
    "dropped_off_brand": (4, 5, "dont hors marque"),
    "sarcasm": (6, 2, "Messages sarcastiques"),
    "churn_risk": (6, 3, "Messages avec risque de départ"),
}

# breakdown -> (section, place, heading)
BREAKDOWNS = {
    "by_intent": (5, 1, "Intentions"),
    "by_complaint_type": (5, 2, "Types de plaintes"),
    "by_priority": (5, 3, "Priorités des plaintes"),
    "by_sentiment": (6, 1, "Sentiments"),
}

TITLE = "Rapport sur la voix des clients"
SECTIONS = (
    "Volumes", "Comptes officiels", "Structure du flux", "Filtrage", "Classement",
    "Sentiment, sarcasme et risque de départ",
)
NOT_AVAILABLE = "N/A"


def _figures(df: DataFrame, figures: dict[str, Column | None]) -> tuple[list[str], DataFrame]:
    """The figures' names, and ``(metric, value)`` from one pass over one stage.

    None as a figure means null.
    """
    null = F.lit(None).cast("bigint")
    # A constant alone would give no aggregate, hence the max.
    row = df.agg(*[
        (F.max(null) if figure is None else figure).alias(name)
        for name, figure in figures.items()
    ])
    return list(figures), row.unpivot([], list(figures), "metric", "value")


def _official(df: DataFrame, config: VoiceConfig) -> Column:
    if not has_columns(df, "screen_name"):
        return F.lit(False)
    return is_official(F.col("screen_name"), config)


def _count_column(df: DataFrame, column: str, condition: Column) -> Column | None:
    return count_if(condition) if has_columns(df, column) else None


def stage_figures(
    raw: DataFrame | None,
    prepared: DataFrame | None,
    enriched: DataFrame | None,
    config: VoiceConfig = DEFAULT,
) -> DataFrame:
    """``(metric, value)`` for every figure of the report; each stage may be missing.

    A missing stage counts 0 rows; a figure that cannot be told is null.  A null
    or blank reply, retweet or quote marker counts as absent.
    """
    spark = next(d for d in (raw, prepared, enriched) if d is not None).sparkSession
    rows = F.count(F.lit(1))
    parts = []

    typed = prepared is not None and has_columns(prepared, "tweet_type")
    if raw is not None:
        def marked(column: str) -> Column:
            return is_filled(F.col(column)) if has_columns(raw, column) else F.lit(False)

        figures = {
            "total_raw": rows,
            "official_raw": count_if(_official(raw, config)),
            "official_replies_raw": count_if(_official(raw, config) & marked("in_reply_to")),
        }
        if not typed:
            figures |= {
                "retweets": count_if(marked("retweeted_status")),
                "replies": count_if(marked("in_reply_to")),
                "quotes": count_if(marked("quoted_status")),
            }
        parts.append(_figures(raw, figures))
    if prepared is not None:
        kind = F.col("tweet_type")
        keep, about = F.col("keep_for_analysis"), F.col("is_about_brand")
        figures = {
            "total_prepared": rows,
            "official_prepared": count_if(_official(prepared, config)),
            "kept": _count_column(prepared, "keep_for_analysis", parse_bool(keep)),
            "dropped": _count_column(prepared, "keep_for_analysis", ~parse_bool(keep)),
            "dropped_official": _count_column(
                prepared, "author_type", F.col("author_type") == "official"
            ),
            "dropped_retweets": _count_column(prepared, "tweet_type", kind == "retweet"),
            "dropped_off_brand": _count_column(prepared, "is_about_brand", ~parse_bool(about)),
        }
        if typed:
            figures |= {
                "retweets": count_if(kind == "retweet"),
                "replies": count_if(kind == "reply"),
                "quotes": count_if(kind == "quote"),
            }
        parts.append(_figures(prepared, figures))
    if enriched is not None:
        parts.append(_figures(enriched, {
            "total_enriched": rows,
            "official_enriched": count_if(_official(enriched, config)),
            "sarcasm": _count_column(
                enriched, "final_sarcasm", parse_bool(F.col("final_sarcasm"), TRUE_WORDS_SHORT)
            ),
            "churn_risk": _count_column(
                enriched, "nlp_has_resiliation_risk",
                parse_bool(F.col("nlp_has_resiliation_risk"), TRUE_WORDS_SHORT),
            ),
        }))
    # Figures no stage tells: totals and structure are 0, the rest is unknown.
    told = {m for names, _ in parts for m in names}
    absent = [(m, 0 if FIGURES[m][0] <= 3 else None) for m in FIGURES if m not in told]
    tables = [table for _, table in parts]
    if absent:
        tables.append(literal_rows(spark, absent, "metric string, value bigint"))
    return reduce(DataFrame.unionByName, tables)


def result_counts(enriched: DataFrame) -> DataFrame:
    """``(section, key, n)`` of intents, complaint types and priorities, sentiments."""
    always = F.lit(True)
    complaint = (
        F.col("final_intent") == "complaint" if has_columns(enriched, "final_intent") else None
    )
    possible = {
        "by_intent": ("final_intent", always),
        "by_complaint_type": ("final_complaint_type", complaint),
        "by_priority": ("final_priority", complaint),
        "by_sentiment": ("final_sentiment", always),
    }
    wanted = {
        name: (column, condition) for name, (column, condition) in possible.items()
        if condition is not None and has_columns(enriched, column)
    }
    # The condition reads final_intent, which therefore has to be among the counted columns.
    return counts_in_one_pass(enriched, wanted)


def report_metrics(
    raw: DataFrame | None = None,
    prepared: DataFrame | None = None,
    enriched: DataFrame | None = None,
    config: VoiceConfig = DEFAULT,
) -> DataFrame:
    """Long table ``(section, metric, key, value)`` of all the report tells."""
    figures = stage_figures(raw, prepared, enriched, config).select(
        F.lit("figures").alias("section"), "metric", F.lit(None).cast("string").alias("key"),
        "value",
    )
    if enriched is None:
        return figures
    counts = result_counts(enriched).select(
        F.lit("breakdowns").alias("section"), F.col("section").alias("metric"), "key",
        F.col("n").alias("value"),
    )
    return figures.unionByName(counts)


def report_lines(metrics: DataFrame) -> DataFrame:
    """``(line_no, line)`` of the report in Markdown, from ``report_metrics``.

    There is a line per figure and per value that occurs, so the numbering sorts
    a few dozen rows whatever the size of the tables.
    """
    spark = metrics.sparkSession
    known = [(m, s, p, text) for m, (s, p, text) in (FIGURES | BREAKDOWNS).items()]
    layout = literal_rows(spark, known, "metric string, part int, place int, label string")
    placed = metrics.join(F.broadcast(layout), "metric")
    value = F.coalesce(F.col("value").cast("string"), F.lit(NOT_AVAILABLE))
    name = F.coalesce(F.col("key"), F.col("label"))
    body = placed.select(
        "part", "place", F.when(F.col("section") == "figures", 0).otherwise(2).alias("level"),
        (-F.coalesce("value", F.lit(0))).alias("weight"), name.alias("name"),
        F.concat(F.lit("- "), name, F.lit(" : **"), value, F.lit("**")).alias("line"),
    )
    # A breakdown has a heading only if it has lines.
    headings = placed.where(F.col("section") == "breakdowns").select(
        "part", "place", F.lit(1).alias("level"), F.lit(0).cast("bigint").alias("weight"),
        F.col("label").alias("name"), F.concat(F.lit("### "), F.col("label")).alias("line"),
    ).distinct()
    titles = [(0, 0, 0, 0, "", f"# {TITLE}")] + [
        (i + 1, 0, 0, 0, "", f"## {i + 1}. {title}") for i, title in enumerate(SECTIONS)
    ]
    fixed = literal_rows(
        spark, titles, "part int, place int, level int, weight bigint, name string, line string"
    )
    lines = body.unionByName(headings).unionByName(fixed)
    order = Window.orderBy("part", "place", "level", "weight", "name")
    return lines.select(F.row_number().over(order).cast("bigint").alias("line_no"), "line")


def write_report(lines: DataFrame, path: str) -> str:
    """The report as one text file in folder ``path``."""
    lines.orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(path)
    return path
