import pytest
from pyspark.sql import functions as F

from custvoice import schema
from custvoice.operators import classify
from custvoice.plans import enrichment, report
from custvoice.queries import FINAL_COLUMNS, answers, enriched_stage, stages
from custvoice.sources import posts, tables
from custvoice.streaming import enrich_stream

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def raw_csv(spark, tmp_path):
    ordered = posts.posts(spark, SF_DIR).orderBy("_seq").drop("_seq")
    return tables.write_stage(ordered, str(tmp_path / "raw"), "csv")


def test_whole_job_from_csv(spark, tmp_path, raw_csv):
    stored = answers(spark, SF_DIR)
    paths = [str(tmp_path / "out" / p) for p in ("prepared", "enriched")]

    def run(**kwargs):
        return enrichment.run_enrichment(
            spark, raw_csv, *paths, lambda df: classify.classify_stored(df, stored), **kwargs)

    first = run()
    assert first.ran and first.posts.count() == posts.posts(spark, SF_DIR).count()
    # The same verdicts as from the derived table, whose ids occur in the same order.
    columns = ["id", "text_clean", *FINAL_COLUMNS]
    direct = enriched_stage(spark, SF_DIR).select(columns)
    assert first.posts.select(columns).exceptAll(direct).count() == 0
    # Key figures read the written table.
    plan = first.kpis["by_intent"]._jdf.queryExecution().optimizedPlan().toString()
    assert "final_intent" in plan and "full_text" not in plan.split("Relation")[0]

    assert not run().ran
    # A stage without its mark was left by a stopped job: it is made again.
    (tmp_path / "out" / "enriched" / "_SUCCESS").unlink()
    assert run(line_breaks=False).ran and not run().ran
    with pytest.raises(FileExistsError):
        run(on_existing="error")
    with pytest.raises(ValueError):
        run(on_existing="sometimes")
    capped = run(on_existing="overwrite", limit=5)
    assert capped.ran
    assert capped.posts.where("keep_for_analysis").count() == 5
    prepared = spark.read.parquet(paths[0])
    assert prepared.where("keep_for_analysis").count() > 5


def test_days_are_listed_by_few_tasks(spark, tmp_path, raw_csv, monkeypatch):
    """The folders of the days are listed once to count and once to be returned, not in a task each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    usual, listed = spark.conf.get(key), []
    reader = type(spark.read)
    plain = reader.parquet

    def parquet(self, *paths, **options):
        listed.extend(spark.conf.get(key) for p in paths if "/enriched" in p and "_cube" not in p)
        return plain(self, *paths, **options)

    monkeypatch.setattr(reader, "parquet", parquet)
    stored = answers(spark, SF_DIR)
    job = enrichment.run_enrichment(
        spark, raw_csv, str(tmp_path / "prepared"), str(tmp_path / "enriched"),
        lambda df: classify.classify_stored(df, stored), by_day=True)
    assert listed == [str(4 * spark.sparkContext.defaultParallelism)] * 2
    assert spark.conf.get(key) == usual
    assert job.cube.agg(F.sum("n")).first()[0] == job.posts.count()


def test_shuffles_follow_the_input(spark, tmp_path, monkeypatch):
    from custvoice import session
    path = tables.write_stage(spark.range(10_000), str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").rglob("*") if f.is_file())
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with session.shuffles_for(spark, path) as small:
        assert small == 8 and spark.conf.get(key) == "8"
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 1000)
    with session.shuffles_for(spark, path) as large:
        assert abs(large - size / 1000) < 2 and spark.conf.get(key) == str(large)
    assert spark.conf.get(key, None) is None


def test_shuffles_of_very_large_inputs():
    from custvoice.session import SHUFFLE_LIMIT, shuffle_partitions
    assert shuffle_partitions(10**14, 200) == SHUFFLE_LIMIT
    assert shuffle_partitions(10**14, 2 * SHUFFLE_LIMIT) == 2 * SHUFFLE_LIMIT
    assert shuffle_partitions(100 << 30, 200) == 1600 and shuffle_partitions(0, 200) == 200


def test_invariants(spark):
    prepared, enriched = stages(spark, SF_DIR)
    total = prepared.count()
    metrics = report.report_metrics(prepared, prepared, enriched)
    values = {(r.metric, r.key): r.value for r in metrics.collect()}
    assert values["kept", None] + values["dropped", None] == total
    by_intent = {k[1]: v for k, v in values.items() if k[0] == "by_intent"}
    assert sum(by_intent.values()) == total == values["total_enriched", None]
    for part in ("by_priority", "by_complaint_type"):
        assert sum(v for k, v in values.items() if k[0] == part) == by_intent["complaint"]
    assert enriched.schema.names == [
        n for n in enriched.columns if n in schema.ENRICHED.names]
    assert set(enriched.columns) == set(schema.ENRICHED.names)


def test_report_of_missing_stages(spark):
    prepared, enriched = stages(spark, SF_DIR)
    only = {r.metric: r.value for r in report.report_metrics(prepared=prepared).collect()}
    assert only["total_raw"] == 0 and only["total_enriched"] == 0
    assert only["sarcasm"] is None and only["kept"] > 0 and only["retweets"] > 0
    bare = spark.createDataFrame([("x",)], "full_text string")
    told = {r.metric: r.value for r in report.report_metrics(bare, bare, bare).collect()}
    assert set(told) == set(report.FIGURES)
    assert told["total_prepared"] == 1 and told["kept"] is None and told["retweets"] == 0
    lines = [r.line for r in report.report_lines(
        report.report_metrics(bare)).orderBy("line_no").collect()]
    assert lines[0].startswith("# ") and "- Messages retenus : **N/A**" in lines
    assert not any(line.startswith("###") for line in lines)


def test_report_file(spark, tmp_path):
    prepared, enriched = stages(spark, SF_DIR)
    lines = report.report_lines(report.report_metrics(prepared, prepared, enriched))
    path = report.write_report(lines, str(tmp_path / "report"))
    files = list((tmp_path / "report").glob("part-*"))
    assert len(files) == 1
    text = files[0].read_text(encoding="utf8").splitlines()
    assert text == [r.line for r in lines.orderBy("line_no").collect()]
    assert [t for t in text if t.startswith("### ")] == [
        "### Intentions", "### Types de plaintes", "### Priorités des plaintes", "### Sentiments"]
    assert path.endswith("report")


def test_stream_gives_the_batch_result(spark, tmp_path):
    raw = posts.posts(spark, SF_DIR)
    folder = str(tmp_path / "in")
    raw.repartition(3).write.parquet(folder)
    stored = answers(spark, SF_DIR)
    stream = enrich_stream.read_raw_stream(spark, folder, files_per_batch=1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        query = enrich_stream.write_enriched_stream(
            enrich_stream.enrich_stream(stream, stored), out, checkpoint, once=True)
        assert query.awaitTermination(240)

    run()
    columns = ["_seq", "text_clean", "intent", "llm_explanation", *FINAL_COLUMNS]
    batch = enriched_stage(spark, SF_DIR).select(columns)
    streamed = spark.read.parquet(out).select(columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0
    raw.where(F.col("_seq") < 300).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert spark.read.parquet(out).count() == batch.count() + raw.where("_seq < 300").count()
