"""The status log with snapshots gives what the whole log gives, also while it changes."""

import pytest
from pyspark.sql import functions as F

from custvoice.operators import tickets
from custvoice.sources import status_log
from custvoice.sources.status_log import StatusLog
from custvoice.sources.versions import ConflictingVersion

ENTRY = "ticket_id string, ts timestamp, event_id bigint, status string, note string"


def entries(spark, rows):
    made = [(i, f"2024-01-0{d} 00:00:00", e, s, f"note {e}") for i, d, e, s in rows]
    return spark.createDataFrame(made, "ticket_id string, ts string, event_id bigint, status string, note string").withColumn(
        "ts", F.col("ts").cast("timestamp"))


def state(log):
    return {r["ticket_id"]: (r["status"], r["note"]) for r in log.state().collect()}


FIRST = [("1", 1, 1, "Nouveau"), ("1", 2, 2, "En cours"), ("2", 3, 3, "Résolu"), ("2", 3, 2, "Nouveau")]


def test_snapshots(spark, tmp_path):
    log = StatusLog(spark, str(tmp_path / "s"))
    assert state(log) == {} and log.compact() == 1 and state(log) == {}
    log.append(entries(spark, FIRST))
    whole = {"1": ("En cours", "note 2"), "2": ("Résolu", "note 3")}
    assert state(log) == whole and log.tail().count() == 4
    assert log.compact() == 2 and log.tail().count() == 0 and state(log) == whole
    # An earlier entry that arrives late changes nothing, a later one does.
    log.append(entries(spark, [("1", 1, 9, "Résolu"), ("3", 1, 9, "Nouveau"), ("2", 4, 1, "En cours")]))
    whole |= {"3": ("Nouveau", "note 9"), "2": ("En cours", "note 1")}
    assert state(log) == whole and log.tail().count() == 3
    assert log.compact() == 3 and state(log) == whole
    assert log.purge() > 0 and state(log) == whole and log.purge() == 0
    log.append(entries(spark, [("4", 1, 1, "Nouveau")]))
    assert set(state(log)) == {"1", "2", "3", "4"}


def test_a_change_during_compaction(spark, tmp_path, monkeypatch):
    log = StatusLog(spark, str(tmp_path / "s"))
    log.append(entries(spark, FIRST))
    read = status_log.last_entries

    def late(rows):
        monkeypatch.setattr(status_log, "last_entries", read)
        log.append(entries(spark, [("1", 9, 9, "Résolu")]))
        return read(rows)

    monkeypatch.setattr(status_log, "last_entries", late)
    log.compact()
    assert log.tail().count() == 1 and state(log)["1"] == ("Résolu", "note 9")


def test_two_compactions_at_once(spark, tmp_path, monkeypatch):
    log = StatusLog(spark, str(tmp_path / "s"))
    log.append(entries(spark, FIRST))
    read = status_log.last_entries

    def other(rows):
        monkeypatch.setattr(status_log, "last_entries", read)
        log.compact()
        return read(rows)

    monkeypatch.setattr(status_log, "last_entries", other)
    with pytest.raises(ConflictingVersion):
        log.compact()
    assert state(log)["1"] == ("En cours", "note 2")


def test_recorded_changes(spark, tmp_path):
    """Changes recorded now: of two of one ticket in one append the later row counts; statuses are checked."""
    log = StatusLog(spark, str(tmp_path / "s"))
    changes = spark.createDataFrame([("1", "Nouveau", None), ("1", "Résolu", "fait")], "ticket_id string, status string, note string").coalesce(1)
    log.record(changes)
    assert state(log) == {"1": ("Résolu", "fait")}
    log.compact()
    log.record(changes.where("status = 'Nouveau'"))
    assert state(log) == {"1": ("Nouveau", "")}
    with pytest.raises(Exception):
        log.record(spark.createDataFrame([("1", "Perdu", "")], "ticket_id string, status string, note string"))
    assert state(log) == {"1": ("Nouveau", "")}
    shown = spark.createDataFrame([(0, "1"), (1, "9")], "_seq bigint, ticket_id string")
    assert [tuple(r) for r in tickets.with_status(shown, log.state()).orderBy("_seq").select("status", "note").collect()] == [("Nouveau", ""), ("Nouveau", "")]
