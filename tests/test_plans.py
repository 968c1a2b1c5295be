"""What the physical plans may and may not hold."""

import datetime
import re

import pytest

from custvoice.operators import dashboard, features, feed, kpis
from custvoice.queries import enriched_stage, queries, raw_posts
from custvoice.sources import tables

SF_DIR = "/root/testdata/sf0.001"
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF", "MapInArrow")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_and_no_cartesian_product(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    for node in (*PYTHON, "CartesianProduct", "NestedLoopJoin", "ExistingRDD"):
        assert node not in plan, node


def test_folded_text_is_projected_once(spark):
    df = features.lexical_features(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "text")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    tested = re.findall(r"Contains\((\w+)", plan)
    # One more test is the search for doubled spaces within the folding itself.
    assert len(tested) > 90 and set(tested) == {"_lexical", "translate"}
    assert tested.count("translate") == 1


def test_figures_read_their_columns_only(spark):
    enriched = enriched_stage(spark, SF_DIR)
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", plan_of(kpis.complaints_by_priority(enriched)))
    assert schema.group(1) == "struct<final_intent:string,final_priority:string>"
    plan = plan_of(kpis.complaints_by_priority(enriched))
    assert "EqualTo(final_intent,complaint)" in plan


def test_period_reaches_the_scan(spark):
    plan = plan_of(queries()["manager_filtered"](spark, SF_DIR))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "GreaterThanOrEqual(created_ts,2024-01-03" in pushed
    assert "LessThan(created_ts,2024-01-21" in pushed
    assert "RLIKE" not in plan


def test_days_outside_the_period_are_not_read(spark, tmp_path):
    day = datetime.date
    enriched = enriched_stage(spark, SF_DIR)
    path = tables.write_stage(enriched, str(tmp_path / "by-day"), by_day=True)
    by_day = spark.read.parquet(path)
    assert by_day.count() == enriched.count()
    assert len(by_day.inputFiles()) == by_day.select("created_day").distinct().count()
    period = (day(2024, 1, 2), day(2024, 1, 4))
    shown = dashboard.filter_posts(dashboard.dashboard_base(by_day), *period)
    plain = dashboard.filter_posts(dashboard.dashboard_base(enriched), *period)
    assert shown.select("_seq").exceptAll(plain.select("_seq")).count() == 0
    assert shown.count() == plain.count() > 0
    filters = re.search(r"PartitionFilters: \[(.*?)\]", plan_of(shown)).group(1)
    assert "created_day" in filters and "2024-01-02" in filters


def test_report_scans_each_stage_once_per_table(spark):
    plan = plan_of(queries()["report_metrics"](spark, SF_DIR))
    assert plan.count("FileScan parquet") == 4


@pytest.mark.parametrize("name, scans", [
    ("classify_stored", 4), ("feed_embedded", 4), ("ticket_status", 3), ("feed_reply_counts", 2)])
def test_lookups_read_each_side_once(spark, name, scans):
    plan = plan_of(queries()[name](spark, SF_DIR))
    assert plan.count("FileScan parquet") <= scans


def test_timeline_reads_the_feed_a_few_times(spark):
    base = feed.feed_base(raw_posts(spark, SF_DIR))
    assert plan_of(feed.timeline(feed.posts_of(base), base)).count("FileScan parquet") <= 8


def test_small_scans_are_spread_and_large_ones_left_alone(spark):
    scan = raw_posts(spark, SF_DIR)
    assert scan.rdd.getNumPartitions() >= 1
    assert "Exchange RoundRobin" in plan_of(tables.balanced(scan.coalesce(1)))
    spread = spark.range(0, 100, 1, 64)
    assert tables.balanced(spread) is spread
