"""The whole job: raw posts to prepared posts, enriched posts and key figures."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from custvoice.config import DEFAULT, VoiceConfig
from custvoice.operators.classify import cap_kept
from custvoice.operators.cube import CUBE, build_cube, compute_kpis
from custvoice.operators.features import lexical_features
from custvoice.operators.prepare import prepare
from custvoice.operators.reconcile import reconcile
from custvoice.session import few_listings, shuffles_for
from custvoice.sources.tables import (
    path_exists, read_raw, read_text, replace_folder, stage_finished, write_stage, write_text,
)
from custvoice.sources.versions import files_fingerprint, input_files, settings_fingerprint

# Adds the verdict columns to prepared posts.
Classifier = Callable[[DataFrame], DataFrame]

# Beside a stage's files: what it was made from.
MADE_FROM = "_made_from"


@dataclass(frozen=True)
class Enriched:
    posts: DataFrame
    cube: DataFrame  # the dashboard's counts, which all key figures are sums of
    kpis: dict[str, DataFrame]
    ran: bool


def enrich_columns(df: DataFrame, config: VoiceConfig = DEFAULT) -> DataFrame:
    """Lexical features and final verdict: the row-wise part after classification."""
    return reconcile(lexical_features(df, "text_clean", config.lexicon))


def enrich(
    raw: DataFrame,
    classifier: Classifier,
    prepared_path: str,
    enriched_path: str,
    limit: int | None = None,
    config: VoiceConfig = DEFAULT,
    by_day: bool = False,
) -> DataFrame:
    """Write the prepared and the enriched stage and return the enriched one.

    ``by_day`` partitions the enriched stage by day.

    Both stages are read back from where they were written.  The classifier and
    the cap scan the prepared table more than once, and whatever follows must
    neither clean the texts again nor call a classifier again.
    """
    spark = raw.sparkSession
    write_stage(prepare(raw, config), prepared_path)
    prepared = spark.read.parquet(prepared_path)
    verdicts = classifier(cap_kept(prepared, limit))
    write_stage(enrich_columns(verdicts, config), enriched_path, by_day=by_day)
    return _listed(spark, enriched_path)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """A stage, which may lie in a folder for each day; reading its files needs no listing again."""
    with few_listings(spark):
        return spark.read.parquet(path)


def run_enrichment(
    spark: SparkSession,
    raw_path: str,
    prepared_path: str,
    enriched_path: str,
    classifier: Classifier,
    limit: int | None = None,
    on_existing: str = "skip",
    fmt: str = "csv",
    config: VoiceConfig = DEFAULT,
    by_day: bool = False,
    line_breaks: bool = True,
    classifier_version: str = "",
) -> Enriched:
    """Run the job unless its results are already there.

    ``on_existing`` says what to do then: ``skip`` returns them, ``overwrite``
    runs again, ``error`` refuses.  Results count for ``skip`` if they are whole and
    were made from the same files, cap, word lists and ``classifier_version``.  New
    results replace old ones when they are finished, not before.  CSV files without line
    breaks inside values are split over tasks if ``line_breaks`` is false.
    """
    if on_existing not in ("skip", "overwrite", "error"):
        raise ValueError(f"unknown choice for existing results: {on_existing}")
    stages = (prepared_path, enriched_path)
    counts_path = f"{enriched_path.rstrip('/')}_cube"
    if on_existing == "error" and any(path_exists(spark, p) for p in stages):
        raise FileExistsError(f"results exist at {prepared_path} or {enriched_path}")
    made_from = settings_fingerprint(
        config, limit, classifier_version, fmt=fmt, by_day=by_day,
        files=files_fingerprint(input_files(spark, raw_path)),
    )
    same = read_text(spark, f"{enriched_path}/{MADE_FROM}") == made_from
    ran = on_existing == "overwrite" or not same or not all(
        stage_finished(spark, p) for p in (*stages, counts_path))
    if ran:
        raw = read_raw(spark, raw_path, fmt, indexed=True, line_breaks=line_breaks)
        drafts = [f"{p.rstrip('/')}.new-{uuid.uuid4().hex}" for p in stages]
        with shuffles_for(spark, raw_path):
            posts = enrich(raw, classifier, *drafts, limit, config, by_day)
        drafts.insert(1, f"{drafts[1]}_cube")
        write_stage(build_cube(posts), drafts[1])
        write_text(spark, f"{drafts[2]}/{MADE_FROM}", made_from)
        # The enriched stage comes last: what it is known by says that all are there.
        for draft, path in zip(drafts, (prepared_path, counts_path, enriched_path)):
            replace_folder(spark, draft, path)
    counts = spark.read.schema(CUBE).parquet(counts_path)
    return Enriched(_listed(spark, enriched_path), counts, compute_kpis(counts), ran)
