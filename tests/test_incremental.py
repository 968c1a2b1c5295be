"""Versions of the enriched posts: what runs again, what does not, what a stopped job leaves."""

import pytest
from pyspark.sql import functions as F

from custvoice import schema
from custvoice.config import Lexicon, VoiceConfig
from custvoice.operators import classify, cube, dashboard
from custvoice.plans import enrichment, incremental
from custvoice.queries import FINAL_COLUMNS, answers, enriched_stage
from custvoice.sources import posts, tables, versions

SF_DIR = "/root/testdata/sf0.001"
ROWS = [
    ("1", "2024-01-03 10:00:00", "Panne fibre free, scandale", "client1"),
    ("2", "2024-01-04 10:00:00", "Merci free pour la box", "client2"),
    ("3", "never", "Idée pour free", "client3"),
    ("4", "2024-01-04 11:00:00", "Free: facture fausse", "client1"),
]


class Job:
    """A job over a folder of CSV files; counts the rows its classifier was given."""

    def __init__(self, spark, folder):
        self.spark, self.raw, self.root, self.given = spark, str(folder / "raw"), str(folder / "store"), []

    def add(self, rows, columns="id string, created_at string, full_text string, screen_name string"):
        frame = self.spark.createDataFrame(rows, columns).coalesce(1)
        frame.write.mode("append").option("header", True).csv(self.raw)

    def classify(self, df):
        self.given.append(df.count())
        stored = self.spark.createDataFrame([(r[0], '{"intent":"complaint","priority":"low"}') for r in ROWS], "id string, llm_response string")
        return classify.classify_stored(df, stored)

    def run(self, version="1", **more):
        return incremental.enrich_new(self.spark, self.raw, self.root, self.classify, version, **more)


@pytest.fixture()
def job(spark, tmp_path):
    made = Job(spark, tmp_path)
    made.add(ROWS[:2])
    return made


def ids(snapshot):
    return [(r["_seq"], r["id"]) for r in snapshot.posts.orderBy("_seq").collect()]


def test_only_added_files_are_enriched(job):
    first = job.run()
    assert first.ran == "rebuilt" and ids(first) == [(0, "1"), (1, "2")] and job.given == [2]
    assert job.run().ran == "nothing" and job.given == [2]
    job.add(ROWS[2:])
    job.add([("5", None, "rien", "client9")])
    second = job.run()
    assert second.ran == "added" and job.given == [2, 3]
    assert [s for s, _ in ids(second)] == list(range(5)) and {i for _, i in ids(second)} == {"1", "2", "3", "4", "5"}
    assert second.files.count() == 3 and {r["segment"] for r in second.files.collect()} == {0, 1}
    assert second.version.number == 2 and second.version.rows == 5 == second.prepared.count()
    # The version before is still there, as it was.
    log = versions.VersionLog(job.spark, job.root)
    assert ids(incremental.Snapshot(log.read(1), "nothing", log)) == [(0, "1"), (1, "2")]
    assert job.run().ran == "nothing"


def test_changes_rebuild(job, spark, tmp_path):
    job.run()
    assert job.run("2").ran == "rebuilt"
    assert job.run("2", limit=1).ran == "rebuilt"
    words = VoiceConfig(lexicon=Lexicon(urgency=("vite",)))
    assert job.run("2", limit=1, config=words).ran == "rebuilt"
    assert job.run("2", limit=1, config=words).ran == "nothing"
    file = next((tmp_path / "raw").glob("part-*"))
    (file.parent / f".{file.name}.crc").unlink()
    file.write_text(file.read_text().replace("Merci", "Bravo"))
    changed = job.run("2", limit=1, config=words)
    assert changed.ran == "rebuilt" and changed.posts.where("full_text like 'Bravo%'").count() == 1
    file.unlink()
    empty = job.run("2", limit=1, config=words)
    assert empty.ran == "rebuilt" and empty.posts.count() == 0 == empty.cube.count()
    job.add(ROWS)
    assert job.run("2", limit=1, config=words).posts.count() == 4


def test_the_cap_counts_over_segments(job):
    job.run(limit=2)
    job.add(ROWS[2:])
    snapshot = job.run(limit=2)
    flagged = [r["id"] for r in snapshot.posts.where("keep_for_analysis").orderBy("_seq").collect()]
    assert flagged == ["1", "2"] and snapshot.version.kept == 2
    assert [s.kept for s in snapshot.version.segments] == [2, 0]


def test_a_stopped_run_leaves_the_version_before(job, monkeypatch):
    first = job.run()
    job.add(ROWS[2:])
    log = versions.VersionLog(job.spark, job.root)

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(incremental, "build_cube", stop)
    with pytest.raises(KeyboardInterrupt):
        job.run()
    assert log.last() == first.version and ids(first) == [(0, "1"), (1, "2")]
    monkeypatch.undo()
    monkeypatch.setattr(versions, "rename_new", stop)
    with pytest.raises(KeyboardInterrupt):
        job.run()
    assert log.last() == first.version
    monkeypatch.undo()
    whole = job.run()
    assert whole.ran == "added" and whole.posts.count() == 4
    gone = log.clean()
    assert len([g for g in gone if "/enriched/" in g]) == 2 and whole.posts.count() == 4 and log.last() == whole.version
    assert job.run().ran == "nothing" and log.clean() == []


def test_two_writers_with_one_number(job):
    first = job.run()
    log = versions.VersionLog(job.spark, job.root)
    with pytest.raises(versions.ConflictingVersion):
        log.publish(first.version)
    assert log.last() == first.version


def test_columns_that_come_later(job):
    job.run()
    job.add([("7", "2024-01-05 10:00:00", "Free lent", "c", "x")],
            "id string, created_at string, full_text string, screen_name string, lang string")
    rows = {r["id"]: r["lang"] for r in job.run().posts.collect()}
    assert rows == {"1": None, "2": None, "7": "x"}


def test_segments_stored_by_day(job):
    job.run(by_day=True)
    job.add(ROWS[2:])
    posts_ = job.run(by_day=True).posts
    assert {str(r[schema.DAY]) for r in posts_.collect()} == {"2024-01-03", "2024-01-04", "None"}


def test_versions_agree_with_the_whole_job(spark, tmp_path):
    """Two segments of the derived posts hold the rows of one run over all of them."""
    stored = answers(spark, SF_DIR)
    raw = str(tmp_path / "raw")
    for late in (False, True):
        part = posts.posts(spark, SF_DIR).where((F.col("_seq") > 1500) == late).orderBy("_seq").drop("_seq")
        part.write.mode("append").parquet(raw)
        snapshot = incremental.enrich_new(spark, raw, str(tmp_path / "s"), lambda df: classify.classify_stored(df, stored), "1", fmt="parquet")
    columns = ["id", "created_at", "text_clean", "keep_for_analysis", *FINAL_COLUMNS]
    whole = enriched_stage(spark, SF_DIR)
    assert snapshot.posts.select(columns).exceptAll(whole.select(columns)).count() == 0
    assert snapshot.posts.count() == whole.count()
    assert sorted(snapshot.cube.collect(), key=repr) == sorted(cube.build_cube(whole).collect(), key=repr)


def test_skip_looks_at_what_results_were_made_from(spark, tmp_path):
    raw = str(tmp_path / "raw")
    spark.createDataFrame(ROWS, "id string, created_at string, full_text string, screen_name string").write.option("header", True).csv(raw)
    stored = spark.createDataFrame([("1", '{"intent":"praise"}')], "id string, llm_response string")

    def run(**more):
        return enrichment.run_enrichment(spark, raw, str(tmp_path / "p"), str(tmp_path / "e"),
                                         lambda df: classify.classify_stored(df, stored), **more)

    assert run().ran and not run().ran
    assert run(limit=1).ran and not run(limit=1).ran
    assert run(limit=1, config=VoiceConfig(brand_keywords=("box",))).ran
    assert run(limit=1, classifier_version="2").ran
    spark.createDataFrame([("9", None, "free", "x")], "id string, created_at string, full_text string, screen_name string").write.mode("append").option("header", True).csv(raw)
    assert run(limit=1, classifier_version="2").posts.count() == 5
    assert sorted(f.name for f in tmp_path.iterdir()) == ["e", "e_cube", "p", "raw"]

    def broken(df):
        raise RuntimeError("no classifier")

    with pytest.raises(RuntimeError):
        enrichment.run_enrichment(spark, raw, str(tmp_path / "p"), str(tmp_path / "e"), broken, on_existing="overwrite")
    assert tables.read_enriched(spark, str(tmp_path / "e")).count() == 5
    with pytest.raises(FileNotFoundError):
        enrichment.run_enrichment(spark, raw + "x", str(tmp_path / "p"), str(tmp_path / "e"), broken)


def test_panels_agree_on_posts_and_counts(spark):
    """Every panel from the cube equals the one from posts, with and without filters, and with no readable time at all."""
    base = dashboard.dashboard_base(enriched_stage(spark, SF_DIR)).select(
        "_seq", "created_ts", "text_clean", "nlp_has_resiliation_risk", *cube.DIMENSIONS, "final_sarcasm").coalesce(1).cache()
    undated = base.withColumn("created_ts", F.lit(None).cast("timestamp"))
    from custvoice.queries import CHOSEN_INTENTS, CHOSEN_PRIORITIES, CHOSEN_SENTIMENTS, CHOSEN_TYPES, PERIOD
    choices = [{}, PERIOD | {"intents": CHOSEN_INTENTS, "sentiments": CHOSEN_SENTIMENTS}, {"intents": ()}, {"sentiments": ("negative",)}]
    for source in (base, undated, base.limit(0)):
        counts = cube.build_cube(source).coalesce(1).cache()
        assert dashboard.date_bounds(source).collect() == cube.date_bounds(counts).collect()
        assert dashboard.facets(source).collect() == cube.facets(counts).collect()
        for choice in choices:
            shown, counted = dashboard.filter_posts(source, **choice), cube.filter_posts(counts, **choice)
            for name in ("by_intent", "daily_volume", "daily_negative"):
                assert getattr(dashboard, name)(shown).collect() == getattr(cube, name)(counted).collect()
            for narrow in ((), (CHOSEN_TYPES, CHOSEN_PRIORITIES)):
                assert dashboard.manager_kpis(shown, *narrow).collect() == cube.manager_kpis(counted, *narrow).collect()
                few, fewer = dashboard.filter_complaints(shown, *narrow), cube.filter_complaints(counted, *narrow)
                for name in ("by_type", "by_priority", "type_priority_matrix"):
                    assert getattr(dashboard, name)(few).collect() == getattr(cube, name)(fewer).collect()


def test_panels_read_the_cube_alone(spark):
    from custvoice import queries
    stored = queries.cube_stage(spark, SF_DIR)
    assert len(stored.inputFiles()) >= 1 and stored.count() < enriched_stage(spark, SF_DIR).count()
    for name in ("manager_kpis", "manager_by_type", "manager_matrix", "daily_volume", "daily_negative", "date_bounds", "facets"):
        files = {f for f in queries.queries()[name](spark, SF_DIR).inputFiles()}
        assert files <= set(stored.inputFiles()), name


def test_key_figures_of_a_run_from_its_cube(spark):
    from custvoice.operators import kpis
    whole = enriched_stage(spark, SF_DIR)
    one, two = kpis.compute_kpis(whole), cube.compute_kpis(cube.build_cube(whole))
    for name, figures in one.items():
        assert figures.collect() == two[name].collect(), name


def test_an_open_period_filters_the_scan(spark, tmp_path):
    path = tables.write_stage(dashboard.dashboard_base(enriched_stage(spark, SF_DIR)), str(tmp_path / "b"))
    plan = dashboard.filter_posts(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "IsNotNull(created_ts)" in plan and "any_dated" not in plan


def test_added_files_are_stored_like_stages(spark):
    """The raw files of the growing input hold every text: they take the stages' codec."""
    from pathlib import Path

    from custvoice import queries
    assert queries.enriched_incremental(spark, SF_DIR).count() == queries.raw_posts(spark, SF_DIR).count()
    root = queries._STAGES[queries._key(spark, SF_DIR, "grown")].removeprefix("file:")
    names = [f.name for f in Path(root, "raw").glob("*.parquet")]
    assert names and all(n.endswith(f".{tables.STAGE_CODEC}.parquet") for n in names)
