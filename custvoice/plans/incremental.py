"""The whole job over an input that grows: only what is new is enriched.

Each run compares the input files with those the last version was made from.  Nothing
new and the same settings: the last version is returned.  Only files added: they become
one more segment, whose rows follow all earlier ones.  A file changed or taken away, or
other settings: everything is made again, in new folders.  The version before stays
readable until the new one is published, and after it until ``VersionLog.clean``.

Rows are numbered in the order in which they arrived: by segment, then by file.  A cap on
scored posts counts over all segments.  Posts are enriched one by one, so a segment's rows
do not depend on the others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvoice import schema
from custvoice.config import DEFAULT, VoiceConfig
from custvoice.operators.cube import CUBE, build_cube, merge_cubes
from custvoice.plans.enrichment import Classifier, enrich
from custvoice.session import shuffles_for
from custvoice.sources.tables import read_raw
from custvoice.sources.versions import (
    FILE, STAGES, Segment, Version, VersionLog, input_files, settings_fingerprint,
)


@dataclass(frozen=True)
class Snapshot:
    """A published version; ``ran`` says what the run that returned it did: nothing, added or rebuilt."""

    version: Version
    ran: str
    log: VersionLog

    def _stage(self, stage: str, declared: T.StructType | str) -> DataFrame:
        if self.version.segments:
            return self.log.stage(stage, self.version)
        return self.log.spark.createDataFrame([], declared)

    @property
    def prepared(self) -> DataFrame:
        return self._stage("prepared", schema.PREPARED)

    @property
    def posts(self) -> DataFrame:
        return self._stage("enriched", schema.ENRICHED)

    @property
    def cube(self) -> DataFrame:
        """The dashboard's counts of all posts, from those of each segment."""
        return merge_cubes(self._stage("cube", CUBE))

    @property
    def files(self) -> DataFrame:
        """The input files, with the number of the segment that holds each."""
        return self.log.spark.read.schema(FILE + ", segment int").parquet(self.version.manifest)


def enrich_new(
    spark: SparkSession,
    raw_path: str,
    root: str,
    classifier: Classifier,
    classifier_version: str,
    limit: int | None = None,
    fmt: str = "csv",
    config: VoiceConfig = DEFAULT,
    line_breaks: bool = True,
    by_day: bool = False,
) -> Snapshot:
    """Bring the version under ``root`` up to the files at ``raw_path``.

    ``classifier_version`` is part of what a version is known by: change it whenever the
    classifier, or the answers it reads, change.
    """
    log = VersionLog(spark, root)
    last = log.last()
    settings = settings_fingerprint(config, limit, classifier_version, fmt=fmt, line_breaks=line_breaks)
    files = input_files(spark, raw_path)
    ran, segments = "rebuilt", ()
    fresh = files
    if last and last.settings == settings:
        known = spark.read.schema(FILE + ", segment int").parquet(last.manifest)
        same = ["path", "length", "modified"]
        if known.join(files, same, "left_anti").isEmpty():
            fresh = files.join(known, same, "left_anti")
            ran, segments = "added", last.segments
    # Spark's own scan of these files lists them on the driver as well.
    found = fresh.select("path", "length").collect()
    paths = sorted(row["path"] for row in found)
    if not paths and ran == "added":
        return Snapshot(last, "nothing", log)

    manifest = log.fresh_manifest()
    listed = fresh.withColumn("segment", F.lit(len(segments)))
    if segments:
        listed = listed.unionByName(known)
    listed.coalesce(max(1, len(paths) // 100_000)).write.parquet(manifest)
    if paths:
        before = Version(0, settings, manifest, segments)
        left = None if limit is None else max(0, limit - before.kept)
        raw = read_raw(spark, paths, fmt, indexed=True, line_breaks=line_breaks, several=True)
        with shuffles_for(spark, raw_path, stored=sum(row["length"] for row in found)):
            segments += (_segment(raw, log, before.rows, classifier, left, config, by_day),)
    version = Version(last.number + 1 if last else 1, settings, manifest, segments)
    return Snapshot(log.publish(version), ran, log)


def _segment(
    raw: DataFrame, log: VersionLog, first: int, classifier: Classifier, limit: int | None, config: VoiceConfig, by_day: bool
) -> Segment:
    """Enrich some files as rows numbered from ``first``."""
    name = uuid.uuid4().hex
    prepared, enriched, counts = (log.folder(stage, name) for stage in STAGES)
    moved = raw.withColumn(schema.SEQ, F.col(schema.SEQ) + F.lit(first))
    posts = enrich(moved, classifier, prepared, enriched, limit, config, by_day)
    build_cube(posts).write.parquet(counts)
    rows, kept = posts.agg(F.count(F.lit(1)), F.count_if("keep_for_analysis")).first()
    return Segment(name, first, rows, kept)
