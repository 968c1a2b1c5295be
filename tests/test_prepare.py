from itertools import product

import pytest

from custvoice.config import VoiceConfig
from custvoice.operators import feed, prepare


def test_post_type_truth_table(spark):
    texts = [None, "RT x", "RTx", " RT x", "free"]
    replies = [None, "", "  ", "12", "nan"]
    quotes = [None, "True", "TRUE", "false", " true"]
    cases = [(i, *c) for i, c in enumerate(product(texts, replies, quotes))]
    df = spark.createDataFrame(
        cases, "n int, full_text string, in_reply_to_status_id string, is_quote_status string")
    out = df.orderBy("n").select(prepare.post_type(df)).collect()
    for (_, text, reply, quote), row in zip(cases, out):
        if text and text.startswith("RT "):
            expected = "retweet"
        elif reply is not None and reply.strip():
            expected = "reply"
        else:
            expected = "quote" if quote and quote.lower() == "true" else "original"
        assert row[0] == expected


def test_feed_type_truth_table(spark):
    marks = [None, "", " ", "nan", "NaN ", "7"]
    cases = [(i, *c) for i, c in enumerate(product(marks, marks, marks, [None, "RT x", "x"]))]
    df = spark.createDataFrame(
        cases, "n int, retweeted_status string, quoted_status string, in_reply_to string, "
        "full_text string")
    out = df.orderBy("n").select(feed.feed_type(df)).collect()

    def there(mark):
        return (mark or "").strip().lower() not in ("", "nan")

    for (_, shared, quoted, reply, text), row in zip(cases, out):
        expected = next((name for name, test in [
            ("retweet", there(shared)), ("quote", there(quoted)), ("reply", there(reply)),
            ("retweet", (text or "").startswith("RT "))] if test), "original")
        assert row[0] == expected


def test_prepare_falls_back_to_other_columns(spark):
    df = spark.createDataFrame([("Bonjour Freebox  !", "client"), (None, "free")],
                               "text string, user_screen_name string")
    first, second = prepare.prepare(df).collect()
    assert (first.text_clean, first.tweet_type, first.keep_for_analysis) == (
        "Bonjour Freebox !", "original", True)
    assert (second.text_clean, second.author_type, second.keep_for_analysis) == (
        "", "official", False)


def test_prepare_needs_a_text(spark):
    with pytest.raises(ValueError):
        prepare.prepare(spark.createDataFrame([("x",)], "screen_name string"))


def test_accounts_and_brand_are_configurable(spark):
    config = VoiceConfig(official_accounts=("acme",), brand_keywords=("acme",),
                         reply_column="in_reply_to")
    df = spark.createDataFrame(
        [("acme", "acme", None), ("Freebox", "ACME !", "3"), (None, "free", None)],
        "screen_name string, full_text string, in_reply_to string")
    out = [(r.author_type, r.tweet_type, r.keep_for_analysis)
           for r in prepare.prepare(df, config).collect()]
    assert out == [("official", "original", False), ("customer", "reply", True),
                   ("customer", "original", False)]


def test_account_match_is_case_sensitive(spark):
    df = spark.createDataFrame([("FREE", "x"), ("free", "x"), ("Free_1337", "x")],
                               "screen_name string, full_text string")
    assert [r.author_type for r in prepare.prepare(df).collect()] == [
        "customer", "official", "official"]
