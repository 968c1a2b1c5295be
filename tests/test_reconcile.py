"""The final verdict over the whole product of its inputs."""

from itertools import product

from custvoice.operators.reconcile import reconcile

LADDER = ["none", "low", "medium", "high", "critical"]
INTENTS = ["complaint", "other", "thanks", "unknown"]
TYPES = ["none", "other_complaint", "billing_issue"]
TOPICS = ["", "fiber_issue,tv_service_issue"]
BOOLS = [False, True]
FIELDS = (
    "intent string, complaint_type string, sentiment string, sarcasm boolean, priority string, "
    "nlp_sentiment_score int, nlp_probable_complaint boolean, nlp_has_urgency boolean, "
    "nlp_has_resiliation_risk boolean, nlp_topics string, nlp_sarcasm_hint boolean"
)


def expected(intent, kind, feeling, mocking, priority, score, probable, urgent, leaving, topics,
             hint):
    is_complaint = intent == "complaint" or (score >= 2 and (probable or intent == "other"))
    final = "complaint" if is_complaint else intent
    if not is_complaint:
        final_kind, level = "none", "none"
    else:
        vague = kind in ("none", "other_complaint")
        final_kind = topics.split(",")[0] if vague and topics else kind
        step = LADDER.index(priority) if priority in LADDER else 0
        if leaving:
            step = max(step, 3)
        level = LADDER[min(4, step + urgent + (score >= 3))]
    mock = mocking or hint
    return final, final_kind, level, "negative" if mock and feeling == "positive" else feeling, mock


def test_truth_table(spark):
    cases = list(product(
        INTENTS, TYPES, ["positive", "neutral"], BOOLS, [*LADDER, "urgent"], [1, 2, 3], BOOLS,
        BOOLS, BOOLS, TOPICS, [False]))
    cases += list(product(INTENTS, ["none"], ["positive", "negative"], BOOLS, ["low"], [0, 2],
                          BOOLS, [True], [False], TOPICS, [True]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, " + FIELDS)
    columns = ["final_intent", "final_complaint_type", "final_priority", "final_sentiment",
               "final_sarcasm"]
    once = reconcile(df.repartition(8))
    rows = once.orderBy("n").select(columns).collect()
    assert [tuple(r) for r in rows] == [expected(*c) for c in cases]
    again = reconcile(once).orderBy("n").select(columns).collect()
    assert again == rows


def test_missing_columns_count_as_defaults(spark):
    row = reconcile(spark.range(1)).first()
    assert (row.final_intent, row.final_complaint_type, row.final_priority, row.final_sentiment,
            row.final_sarcasm) == ("other", "none", "none", "neutral", False)
