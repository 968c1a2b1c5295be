import datetime

import pytest

from custvoice.operators import tickets

ROWS = [
    # _seq, id, intent, priority, type, created_at, text, sarcasm, churn, tweet_type
    (0, "a", "complaint", "low", "mobile_issue", "2024-01-02", "Panne Free", True, False, "reply"),
    (1, "b", "complaint", "critical", "billing_issue", "2024-01-03", "facture", False, True, "quote"),
    (2, "c", "complaint", "critical", "billing_issue", "2024-01-01", "x\ny", False, False, "REPLY"),
    (3, "d", "complaint", "none", "none", None, None, False, False, "original"),
    (4, "e", "complaint", None, "odd", "2024-01-01", "free.", None, None, None),
    (5, "f", "thanks", "none", "none", "2024-01-01", "merci", False, False, "original"),
]
FIELDS = (
    "_seq long, id string, final_intent string, final_priority string, "
    "final_complaint_type string, created_at string, text_clean string, final_sarcasm boolean, "
    "nlp_has_resiliation_risk boolean, tweet_type string"
)


@pytest.fixture(scope="module")
def queue(spark):
    return tickets.tickets(spark.createDataFrame(ROWS, FIELDS).repartition(3)).cache()


def ids(df):
    return [r.ticket_id for r in df.collect()]


def test_only_complaints(queue):
    assert sorted(ids(queue)) == ["a", "b", "c", "d", "e"]
    assert {r.ticket_id: r.is_comment for r in queue.collect()} == {
        "a": True, "b": False, "c": True, "d": False, "e": False}


def test_order(queue):
    assert ids(tickets.order_tickets(queue)) == ["c", "b", "a", "e", "d"]
    assert ids(tickets.order_tickets(queue, chronological=True)) == ["c", "b", "a", "e", "d"]
    assert ids(tickets.order_tickets(queue.drop("final_priority"))) == ["c", "e", "a", "b", "d"]


def test_filters(queue):
    def found(**kwargs):
        return sorted(ids(tickets.filter_tickets(queue, **kwargs)))

    assert found() == ["a", "b", "c"]
    assert found(priorities=[]) == ["a", "b", "c", "d", "e"]
    assert found(priorities=["none"]) == ["d"]
    assert found(priorities=[], types=["odd", "none"]) == ["d", "e"]
    assert found(only_sarcasm=True) == ["a"]
    assert found(only_churn_risk=True) == ["b"]
    assert found(comments=True) == ["a", "c"]
    assert found(comments=False) == ["b"]
    assert found(priorities=[], search="FREE") == ["a", "e"]
    assert found(priorities=[], search="free.") == ["e"]
    assert found(priorities=[], search="x.y|^fact", regex=True) == ["b"]


def test_labels_and_details(queue):
    labels = {r.ticket_id: r.label for r in queue.withColumn(
        "label", tickets.ticket_label(queue)).collect()}
    assert labels["c"] == "2024-01-01 - [billing_issue] - « x y… »"
    assert labels["d"] == "[none] - « … »"
    detail = tickets.ticket_detail(queue, "a").first()
    assert (detail.screen_name, detail.is_comment, detail.final_sarcasm,
            detail.nlp_has_resiliation_risk) == ("N/A", "Oui", "Oui", "Non")


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_status_is_the_last_written(spark, queue, hot_rows):
    at = datetime.datetime
    log = spark.createDataFrame(
        [("a", at(2024, 1, 1), 1, "En cours", "n1"), ("a", at(2024, 1, 2), 2, "Résolu", "n2"),
         ("a", at(2024, 1, 2), 3, "En cours", "n3"), ("zz", at(2024, 1, 1), 4, "Résolu", "")],
        "ticket_id string, ts timestamp, event_id long, status string, note string")
    rows = {r.ticket_id: (r.status, r.note)
            for r in tickets.with_status(queue, log, hot_rows).collect()}
    assert rows == {"a": ("En cours", "n3"), **{k: ("Nouveau", "") for k in "bcde"}}


def test_status_log_is_append_only(spark, queue, tmp_path):
    path = str(tmp_path / "log")
    fields = "ticket_id string, status string, note string"
    for status, note in [("En cours", "appel"), ("Résolu", None)]:
        tickets.record_status(spark.createDataFrame([("a", status, note)], fields), path)
    log = spark.read.parquet(path)
    assert log.count() == 2
    overlaid = tickets.with_status(queue, log).where("ticket_id = 'a'").first()
    assert (overlaid.status, overlaid.note) == ("Résolu", "")
    with pytest.raises(Exception, match="unknown ticket status: Perdu"):
        tickets.record_status(spark.createDataFrame([("a", "Perdu", "")], fields), path)
    assert spark.read.parquet(path).count() == 2


def test_id_falls_back(spark):
    df = spark.createDataFrame([(7, "s1", "complaint")],
                               "_seq long, status_id string, final_intent string")
    assert tickets.tickets(df).first().ticket_id == "s1"
    assert tickets.tickets(df.drop("status_id")).first().ticket_id == "7"
    assert tickets.ticket_table(tickets.tickets(df)).columns == ["ticket_id", "is_comment"]


def test_comment_from_reply_target(spark):
    df = spark.createDataFrame([("1", " "), ("2", "9"), ("3", None)], "id string, in_reply_to string")
    out = df.select("id", tickets.is_comment(df).alias("c")).orderBy("id").collect()
    assert [r.c for r in out] == [False, True, False]
    assert not spark.range(1).select(tickets.is_comment(spark.range(1))).first()[0]
