"""The tickets' status log: appended entries, and a snapshot that spares reading them all.

Changes are appended as files.  A snapshot holds the last entry of each ticket over a list
of those files; the state is the snapshot and the entries of the files it does not cover,
so a change that arrives while a snapshot is made counts before it and after it.  A
snapshot is published by number, after it has been written, and never replaced.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvoice.operators.tickets import ENTRY, last_entries, record_status
from custvoice.sources.tables import path_exists, remove
from custvoice.sources.versions import Publications, input_files


@dataclass(frozen=True)
class StatusLog:
    spark: SparkSession
    root: str

    @property
    def _entries(self) -> str:
        return f"{self.root}/entries"

    @property
    def _snapshots(self) -> Publications:
        return Publications(self.spark, f"{self.root}/snapshots")

    def record(self, changes: DataFrame) -> None:
        """Append changes ``(ticket_id, status, note)``, which happen now."""
        record_status(changes, self._entries)

    def append(self, entries: DataFrame) -> None:
        """Append entries that have their time: ``ticket_id, ts, event_id, status, note``."""
        entries.select("ticket_id", "ts", "event_id", "status", "note").write.mode("append").parquet(self._entries)

    def _told(self) -> dict | None:
        number = self._snapshots.last()
        return None if number is None else self._snapshots.read(number)

    def tail(self) -> DataFrame:
        """The entries that no snapshot covers."""
        return self._tail(self._told())[0]

    def _tail(self, told: dict | None) -> tuple[DataFrame, DataFrame]:
        """The entries beyond a snapshot, and the files that hold them."""
        nothing = self.spark.createDataFrame([], ENTRY)
        if not path_exists(self.spark, self._entries):
            return nothing, nothing.select(F.lit("").alias("path"))
        files = input_files(self.spark, self._entries).select("path")
        if told:
            covered = self.spark.read.schema("path string").parquet(told["covered"])
            files = files.join(covered, "path", "left_anti")
        # As many names as appends since the last snapshot.
        paths = [r["path"] for r in files.collect()]
        listed = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return (self.spark.read.schema(ENTRY).parquet(*paths) if paths else nothing), listed

    def state(self) -> DataFrame:
        """The last entry of each ticket."""
        return self._state(self._told())[0]

    def _state(self, told: dict | None) -> tuple[DataFrame, DataFrame]:
        tail, files = self._tail(told)
        if told:
            tail = tail.unionByName(self.spark.read.schema(ENTRY).parquet(told["snapshot"]))
        return last_entries(tail), files

    def compact(self) -> int:
        """Write a snapshot of the state as it is now; its number."""
        number = self._snapshots.last()
        told = None if number is None else self._snapshots.read(number)
        state, files = self._state(told)
        name = uuid.uuid4().hex
        made = {kind: f"{self.root}/data/{name}-{kind}" for kind in ("snapshot", "covered")}
        if told:
            files = files.unionByName(self.spark.read.schema("path string").parquet(told["covered"]))
        files.write.parquet(made["covered"])
        state.write.parquet(made["snapshot"])
        number = (number or 0) + 1
        self._snapshots.publish(number, made)
        return number

    def purge(self) -> int:
        """Delete the entries that the last snapshot covers; how many files.  Not while others read them."""
        told = self._told()
        if not told:
            return 0
        there = input_files(self.spark, self._entries).select("path")
        covered = self.spark.read.schema("path string").parquet(told["covered"])
        gone = [r["path"] for r in there.join(covered, "path").collect()]
        for path in gone:
            remove(self.spark, path)
        return len(gone)
