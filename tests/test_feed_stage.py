"""The stored feed: places, pages, threads and searches against the operators on raw posts."""

import pytest
from pyspark.sql import functions as F

from custvoice import queries
from custvoice.operators import feed
from custvoice.plans import feed_stage
from custvoice.queries import feed_posts_base, raw_posts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base(spark):
    return feed_posts_base(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    feed_stage.write_feed(raw_posts(spark, SF_DIR), path, buckets=3)
    return feed_stage.Feed.open(spark, path)


def shown(page):
    return [(r["_seq"], r["comments"], r["orig_screen_name"]) for r in page.collect()]


@pytest.mark.parametrize("kind", [None, "original", "quote"])
def test_pages(stored, base, kind):
    posts = feed.posts_of(base, kind)
    assert stored.page_count(20, kind).collect() == feed.page_count(posts, 20).collect()
    for number in (1, 3, 50):
        expected = feed.timeline_page(posts, base, number, 20).orderBy("place")
        assert shown(stored.page(number, 20, kind)) == shown(expected)
    with pytest.raises(ValueError):
        stored.page(0)
    with pytest.raises(ValueError):
        stored.page(1, 7)


def test_places_are_dense(stored):
    rows = stored.posts.select("place", "kind_place", "feed_type").collect()
    assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1))
    for kind in feed.POST_TYPES:
        own = sorted((r["place"], r["kind_place"]) for r in rows if r["feed_type"] == kind)
        assert [k for _, k in own] == list(range(1, len(own) + 1))


def test_reads_join_and_shuffle_nothing(stored):
    """The whole timeline and all threads are plain scans; a page filters places, a thread opens one folder."""
    for whole in (stored.posts, stored.threads()):
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    page = stored.page(3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(place,41)" in page and "Join" not in page
    thread = stored.thread("0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in thread and "Join" not in thread


def test_threads(stored, base):
    columns = ["post_id", "_seq", "display_text"]
    assert sorted(map(tuple, stored.threads().select(columns).collect())) == sorted(map(tuple, feed.threads(base).select(columns).collect()))
    for post in ("0", "100", "no such post"):
        assert [r["_seq"] for r in stored.thread(post).collect()] == [r["_seq"] for r in feed.thread(base, post).collect()]
    # Within a file, the replies to a post stand together, oldest first.
    for file in stored.replies.inputFiles():
        rows = [(r["post_id"], r["created_ts"] is None, str(r["created_ts"]), r["_seq"]) for r in stored.spark.read.parquet(file).collect()]
        assert rows == sorted(rows, key=lambda r: (r[0] is not None, *r))


@pytest.mark.parametrize("needle", ["fibre", " Fibre ", "CLIENT1", "é", "ré", "décod", "", "zq", "no such thing", "Free mobile, 5G", "\"", "src3"])
def test_search(stored, base, needle):
    for kind in (None, "original"):
        found = feed.search_posts(feed.posts_of(base), needle, kind)
        assert sorted(r["_seq"] for r in stored.search(needle, kind).select("_seq").collect()) == sorted(r["_seq"] for r in found.select("_seq").collect())


def test_search_opens_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed_stage, "BLOCK", 8)
    rows = [(i, str(i), f"2024-01-01 00:{i // 60:02}:{i % 60:02}", f"texte numéro {i} xk{i}kx", f"auteur{i % 5}") for i in range(400)]
    raw = spark.createDataFrame(rows, "_seq bigint, id string, created_at string, full_text string, screen_name string")
    stored = feed_stage.write_feed(raw, str(tmp_path / "f"), buckets=1)
    assert stored.grams.count() == 50
    blocks = stored.blocks("XK123KX")
    assert len(blocks) <= 3 and [r["id"] for r in stored.search("XK123KX").collect()] == ["123"]
    assert len(stored.blocks("texte")) == 50 and stored.blocks("xk") is None and stored.search("xk").count() == 400
    monkeypatch.setattr(feed_stage, "LISTED", 10)
    assert stored.blocks("texte") is None and stored.search("TEXTE").count() == 400


def test_search_does_not_depend_on_how_many_blocks_qualify(spark, tmp_path, monkeypatch):
    expected = sorted(map(tuple, queries.feed_search_blocks(spark, SF_DIR).collect()))
    assert expected
    monkeypatch.setattr(feed_stage, "LISTED", 0)
    assert sorted(map(tuple, queries.feed_search_blocks(spark, SF_DIR).collect())) == expected
    monkeypatch.setattr(feed_stage, "BLOCK", 2)
    monkeypatch.setattr(feed_stage, "STRETCHES", 3)
    rows = [(i, str(i), f"2024-01-01 00:{i // 60:02}:{i % 60:02}", f"texte xk{i % 7}kx" if i % 10 else None, "a" if i % 3 else None) for i in range(100)]
    raw = spark.createDataFrame(rows, "_seq bigint, id string, created_at string, full_text string, screen_name string")
    stored = feed_stage.write_feed(raw, str(tmp_path / "f"), buckets=1)
    assert len(stored.stretches("xk3kx")) == 3 and stored.stretches("no such thing") == []
    for needle in ("XK3KX", "texte", "a", "xk", "no such thing"):
        wanted = [r[0] for r in rows if needle.lower() in (r[3] or "") or needle.lower() in (r[4] or "")]
        assert sorted(r["_seq"] for r in stored.search(needle).collect()) == wanted
        assert sorted(r["_seq"] for r in stored.search(needle).join(stored.holding(needle), "block", "left_semi").collect()) == wanted


def test_hot_post_and_empty_feed(spark, tmp_path):
    rows = [(i, str(i), None, "re", "a", "0" if i else None) for i in range(3000)]
    raw = spark.createDataFrame(rows, "_seq bigint, id string, created_at string, full_text string, screen_name string, in_reply_to string")
    stored = feed_stage.write_feed(raw, str(tmp_path / "hot"), buckets=4)
    assert [r["_seq"] for r in stored.thread("0").collect()] == list(range(1, 3000))
    assert stored.posts.select("comments").collect()[0][0] == 2999
    empty = feed_stage.write_feed(raw.limit(0), str(tmp_path / "none"))
    assert empty.page(1).count() == 0 == empty.threads().count() == empty.search("abc").count()
    assert empty.page_count().first()["pages"] == 0 and empty.thread("0").count() == 0


def test_open_finds_the_layout(stored):
    again = feed_stage.Feed.open(stored.spark, stored.path)
    assert again.buckets == 3 and again.posts.agg(F.max("block")).first()[0] == (again.posts.count() - 1) // feed_stage.BLOCK


def test_texts_wait_until_places_are_known(spark, stored):
    """Rows are ordered and numbered without their texts, which move to their places alone."""
    laid = spark.read.parquet(f"{stored.path}/laid")
    assert not {"full_text", "display_text", "orig_display_text"} & set(laid.columns)
