import pytest
from pyspark.sql import functions as F

from custvoice import schema
from custvoice.session import scratch_dir
from custvoice.sources import columns, tables

CSV = (
    ' id , full_text ,screen_name,final_intent\n'
    '1,"il a dit ""non"", puis\nplus rien",NaN,none\n'
    '2,None,null,NULL\n'
    '3," espaces ",n/a,None \n'
    'x,,"",nan\n'
    '4,NONE,Nan,-nan\n'
)


def test_csv_edge_rows(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV, encoding="utf8")
    df = tables.read_raw(spark, str(path), indexed=True)
    assert df.columns == ["id", "full_text", "screen_name", "final_intent", "_seq"]
    assert [tuple(r) for r in df.orderBy("_seq").collect()] == [
        ("1", 'il a dit "non", puis\nplus rien', None, "none", 0),
        ("2", None, None, None, 1),
        ("3", " espaces ", None, "None ", 2),
        ("x", None, None, None, 3),
        ("4", "NONE", "Nan", None, 4),
    ]


def test_first_existing_path_wins(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id\n7\n", encoding="utf8")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert tables.read_raw(spark, paths).first().id == "7"
    with pytest.raises(FileNotFoundError):
        tables.read_raw(spark, paths[0])
    with pytest.raises(FileNotFoundError):
        tables.read_raw(spark, paths[:1])
    assert tables.read_optional(spark, paths[0]) is None
    with pytest.raises(FileNotFoundError):
        tables.read_enriched(spark, paths[0])


def test_row_index_follows_paths_not_sizes(spark, tmp_path):
    # The second file is much the larger one, so it is scanned first.
    sizes = {"part-a.csv": 3, "part-b.csv": 5000, "part-c.csv": 40}
    n = 0
    for name, size in sizes.items():
        lines = "".join(f"{i},{'x' * 20}\n" for i in range(n, n + size))
        (tmp_path / name).write_text("n,t\n" + lines, encoding="utf8")
        n += size
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = tables.read_raw(spark, str(tmp_path), indexed=True)
        assert df.where(F.col("n") == F.col("_seq").cast("string")).count() == n == df.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_row_index_of_a_split_csv_file(spark, tmp_path):
    path = tmp_path / "large.csv"
    path.write_text("n,t\n" + "".join(f"{i},{'y' * 30}\n" for i in range(20_000)), encoding="utf8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = tables.read_raw(spark, str(path), indexed=True, line_breaks=False)
        assert df.where(F.col("n") == F.col("_seq").cast("string")).count() == 20_000
        assert df.select("_seq").distinct().count() == df.count() == 20_000
        assert tables._scan(spark, str(path), "csv", False).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


@pytest.mark.parametrize("longest", [0, 1000])
def test_row_index_of_parquet(spark, tmp_path, monkeypatch, longest):
    monkeypatch.setattr(columns, "MAX_BROADCAST_BLOCKS", longest)
    path = str(tmp_path / "t")
    spark.range(0, 10_000, 1, 7).write.parquet(path)
    indexed = columns.with_row_index(spark.read.parquet(path), "at")
    assert indexed.where("id = at").count() == 10_000


def test_post_ids(spark, tmp_path):
    path = str(tmp_path / "posts")
    rows = [(None, f"t{i}") for i in range(5)]
    spark.createDataFrame(rows, "id string, text string").coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    out = columns.ensure_post_id(stored).orderBy("id").collect()
    assert [(r.id, r.text) for r in out] == [(str(i), f"t{i}") for i in range(5)]
    kept = stored.withColumn("id", F.when(F.col("text") == "t3", "mine"))
    assert columns.ensure_post_id(kept).where("id is null").count() == 4
    assert columns.ensure_post_id(kept.drop("id").withColumn("_seq", F.lit(9))).first().id == "9"


def test_padding(spark):
    df = spark.createDataFrame([("1", 5)], "id string, views_count int")
    padded = columns.pad_raw(df)
    assert set(padded.columns) == set(schema.RAW.names) - {
        "_seq", "in_reply_to_status_id", "is_quote_status"}
    row = padded.first()
    assert (row.id, row.views_count, row.full_text) == ("1", 5, None)
    assert columns.pad_columns(df, {"id": "other"}) is df


def test_csv_export_reads_back(spark, tmp_path):
    rows = [(0, "a, \"b\"\nc", True, 3, ["fiber_issue", "mobile_issue"]), (1, "", False, -1, []),
            (2, " x ", None, None, None)]
    df = spark.createDataFrame(
        rows, "_seq long, text_clean string, final_sarcasm boolean, nlp_sentiment_score int, "
        "nlp_topics_list array<string>")
    path = tables.write_stage(df, str(tmp_path / "deep" / "csv"), "csv")
    back = tables.read_enriched(spark, path, "csv")
    assert dict(back.dtypes) == dict(df.dtypes)
    # An empty text and a missing one look alike in CSV; a missing flag reads as false.
    assert [tuple(r) for r in back.orderBy("_seq").collect()] == [
        rows[0], (1, None, False, -1, []), (2, " x ", False, None, [])]


def test_stage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "x", True, ["t"])],
                               "_seq long, id string, final_sarcasm boolean, "
                               "nlp_topics_list array<string>")
    path = tables.write_stage(df, str(tmp_path / "stage"))
    back = tables.read_enriched(spark, path)
    assert back.schema.names == schema.ENRICHED.names
    assert back.select(df.columns).collect() == df.collect()
    tables.write_stage(df.limit(0), path)
    assert tables.read_enriched(spark, path).count() == 0


def test_scratch_folder(spark, tmp_path):
    class Session:
        def __init__(self, master, conf):
            self.sparkContext = type(
                "Context", (), {"master": master, "getCheckpointDir": lambda self: None})()
            self.conf = conf

    shared = scratch_dir(Session("yarn", {"spark.checkpoint.dir": "hdfs://x/y/"}), "a")
    assert shared.startswith("hdfs://x/y/a-")
    with pytest.raises(RuntimeError):
        scratch_dir(Session("yarn", {}), "a")
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")


def test_stages_are_stored_small(spark, tmp_path):
    """Texts that repeat words take fewer bytes than the session's own codec stores them in."""
    df = spark.range(3000).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(500)).cast("string")), " ").alias("text")).coalesce(1)
    df.write.parquet(str(tmp_path / "usual"))
    tables.write_stage(df, str(tmp_path / "stage"))
    size = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("*.parquet")) for n in ("usual", "stage")}
    assert size["stage"] < 0.8 * size["usual"]
    assert spark.read.parquet(str(tmp_path / "stage")).exceptAll(df).isEmpty()
