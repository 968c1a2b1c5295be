import pytest
from pyspark.sql import functions as F

from custvoice.operators import feed
from custvoice.sources import posts as derived

SF_DIR = "/root/testdata/sf0.001"

RAW = [
    # _seq, id, created_at, full_text, screen_name, in_reply_to, retweeted, quoted, favorites
    (0, "1", "2024-01-01 10:00:00", " premier post ", "ann", None, None, None, "1250"),
    (1, "2", "2024-01-01 11:00:00", "réponse", "bob", "1", None, None, "1"),
    (2, "3", "bad", "réponse sans date", "eve", "1", None, None, "1"),
    (3, "4", "2024-01-02 09:00:00", "RT premier post", "bob", None, " 1 ", None, "7"),
    (4, "5", "2024-01-03 09:00:00", "je cite", "eve", None, None, "1", "8"),
    (5, "6", "2024-01-04 09:00:00", "RT perdu", "bob", None, "404", None, "9"),
    (6, "1", "2024-01-05 09:00:00", "doublon", "zed", None, None, None, "2000000"),
    (7, "7", None, None, None, "404", None, None, None),
    (8, "8", "bad", "RT par la marque du texte", "ann", "nan", "", None, "x"),
    (9, "9", "2024-01-01 10:30:00", "réponse avant", "ann", "1", None, None, "1"),
]
FIELDS = (
    "_seq long, id string, created_at string, full_text string, screen_name string, "
    "in_reply_to string, retweeted_status string, quoted_status string, favorite_count string"
)


@pytest.fixture(scope="module")
def base(spark):
    return feed.feed_base(spark.createDataFrame(RAW, FIELDS).repartition(4)).cache()


def test_split(base):
    kinds = {r._seq: r.feed_type for r in base.collect()}
    assert kinds == {0: "original", 1: "reply", 2: "reply", 3: "retweet", 4: "quote",
                     5: "retweet", 6: "original", 7: "reply", 8: "retweet", 9: "reply"}
    assert feed.posts_of(base).count() + feed.replies_of(base).count() == len(RAW)


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_timeline(base, hot_rows):
    shown = {r._seq: r for r in feed.timeline(feed.posts_of(base), base, hot_rows).collect()}
    assert sorted(shown) == [0, 3, 4, 5, 6, 8]
    # A retweet embeds the first post of that id and shows its counters.
    assert (shown[3].orig_display_text, shown[3].likes, shown[3].orig_likes) == (
        "premier post", "1.2K", "1.2K")
    # A quote embeds it too, but shows its own.
    assert (shown[4].orig_screen_name, shown[4].likes, shown[4].orig_likes) == ("ann", "8", "1.2K")
    # A lost original leaves the retweet alone.
    assert (shown[5].orig_found, shown[5].display_text, shown[5].likes) == (None, "RT perdu", "9")
    assert (shown[6].likes, shown[8].likes, shown[8].ref_id) == ("2.0M", "0", None)
    assert {k: r.comments for k, r in shown.items()} == {0: 3, 3: 0, 4: 0, 5: 0, 6: 3, 8: 0}


def test_thread_is_oldest_first(base):
    assert [r._seq for r in feed.thread(base, "1").collect()] == [9, 1, 2]
    assert [r._seq for r in feed.threads(base, hot_rows=2).collect()] == [9, 1, 2]


def test_search(base):
    shown = feed.posts_of(base)

    def found(*args, **kwargs):
        return sorted(r._seq for r in feed.search_posts(shown, *args, **kwargs).collect())

    assert found("PREMIER ") == [0, 3]
    assert found("ann") == [0, 8]
    assert found("rt", kind="retweet") == [3, 5, 8]
    assert found("p.rdu") == []
    assert found("p.rdu", regex=True) == [5]
    assert len(found("  ")) == 6


def test_order_puts_unreadable_times_last(base):
    assert [r._seq for r in feed.newest_first(feed.posts_of(base)).collect()] == [6, 5, 4, 3, 0, 8]


def test_pages_are_disjoint_and_complete(spark):
    base = feed.feed_base(derived.posts(spark, SF_DIR)).cache()
    shown = feed.posts_of(base)
    whole = [r._seq for r in feed.newest_first(shown).collect()]
    count = feed.page_count(shown, 50).first()
    assert (count.posts, count.pages) == (len(whole), -(-len(whole) // 50))
    pages, deep = [], []
    last = None
    for number in range(1, count.pages + 1):
        page = feed.page_of(shown, number, 50).orderBy("place").collect()
        pages += [(r.place, r._seq) for r in page]
        if last is not None:
            after = feed.page_after(shown, last.created_ts, last.id, last._seq, 50)
            deep += [r._seq for r in after.orderBy("place").collect()]
        last = page[-1]
    assert pages == list(enumerate(whole, 1))
    assert deep == whole[50:]
    assert feed.page_of(shown, count.pages + 1, 50).count() == 0
    base.unpersist()


def test_page_shows_what_the_timeline_shows(base):
    columns = ["_seq", "id", "display_text", "likes", "orig_likes", "orig_screen_name", "comments"]
    shown = feed.posts_of(base)
    page = feed.timeline_page(shown, base, 1, 10).select(columns).orderBy("_seq").collect()
    assert page == feed.timeline(shown, base).select(columns).orderBy("_seq").collect()


def test_page_sizes(base):
    for size, number in [(15, 1), (20, 0)]:
        with pytest.raises(ValueError):
            feed.page_of(base, number, size)
    assert feed.page_count(base.where(F.lit(False)), 20).first().pages == 0
