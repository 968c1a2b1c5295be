import json
import re

import pytest
from pyspark.sql import functions as F

from custvoice import fixed_values as fixed
from custvoice.operators import classify

EDGE_ANSWERS = [
    '{"intent":"complaint","complaint_type":"billing_issue","sentiment":"negative",'
    '"sarcasm":true,"priority":"high","explanation":"x"}',
    'Voici : {"intent":"praise"} fin', "pas de json", "", "{}", "[1, 2]", '[{"intent":"praise"}]',
    "12", '"x"', '{"intent":"praise",}', '{"intent":"praise"', "{'intent':'praise'}",
    '{"intent":"a"} {"intent":"b"}', '{"intent":"a"},{"intent":"b"}',
    '{"intent":null,"sarcasm":null}', '{"sarcasm":"true"}', '{"sarcasm":"false"}',
    '{"sarcasm":1}', '{"intent":"a","extra":{"b":[1,2]}}', '  {"intent":"a"}  ',
    '```json\n{"intent":\n"a"}\n```', "}{", "{" + "x" * 300 + "}", "y" * 300, None,
]


def read(answer):
    """What a strict JSON reader makes of an answer."""
    default = {"intent": "other", "complaint_type": "none", "sentiment": "neutral",
               "sarcasm": False, "priority": "none"}
    if answer is None:
        return default | {"llm_explanation": fixed.FAILED_CALL + classify.NO_ANSWER}
    try:
        doc = json.loads(answer)
    except json.JSONDecodeError:
        try:
            doc = json.loads(re.search(r"\{.*\}", answer, re.S).group())
        except Exception:
            return default | {"llm_explanation": f"{fixed.UNPARSED_RESPONSE}{answer[:120]}..."}
    if not isinstance(doc, dict):
        doc = None
    if doc is None:
        # Scalars hold no braces and read as unparsed; only arrays get the other reason.
        reason = (fixed.FAILED_CALL + classify.NOT_AN_OBJECT if answer.startswith("[")
                  else f"{fixed.UNPARSED_RESPONSE}{answer[:120]}...")
        return default | {"llm_explanation": reason}
    out = {k: doc[k] if doc.get(k) is not None else v for k, v in default.items()}
    out["sarcasm"] = str(out["sarcasm"]).lower() in ("true", "1")
    return out | {"llm_explanation": doc.get("explanation") or ""}


def test_parse_answer(spark):
    df = spark.createDataFrame(list(enumerate(EDGE_ANSWERS)), "n int, a string")
    parsed = classify.with_parsed(df, F.col("a"))
    rows = parsed.orderBy("n").select(*classify.VERDICT_COLUMNS).collect()
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    for answer, row in zip(EDGE_ANSWERS, rows):
        assert row.asDict() == read(answer), answer


def test_rows_not_kept_stay_unknown(spark):
    df = spark.createDataFrame(
        [(0, "1", True), (1, "1", False), (2, "2", True), (3, None, True)],
        "_seq long, id string, keep_for_analysis boolean")
    answers = spark.createDataFrame([("1", '{"intent":"praise"}')], "id string, llm_response string")
    out = classify.classify_stored(df, answers).orderBy("_seq").collect()
    assert [r.intent for r in out] == ["praise", "unknown", "other", "other"]
    assert [r.llm_explanation for r in out] == [
        "", "", *[fixed.FAILED_CALL + classify.NO_ANSWER] * 2]


def test_first_answer_per_id(spark):
    df = spark.createDataFrame([(3, "a", "c"), (1, "a", "x"), (2, "b", "y"), (0, None, "z")],
                               "_seq long, id string, llm_response string")
    assert sorted(map(tuple, classify.first_answers(df).collect())) == [("a", "x"), ("b", "y")]


POSTS = [(i, f"free {i % 5}", i % 4 != 0) for i in range(40)]


def scorer_factory(folder):
    """A scorer that leaves a file per call and per start, whichever process runs it."""
    def factory():
        import os
        import tempfile
        os.close(tempfile.mkstemp(prefix="start-", dir=folder)[0])

        def score(text):
            os.close(tempfile.mkstemp(prefix="call-", dir=folder)[0])
            if text.endswith("3"):
                raise RuntimeError("service indisponible")
            return json.dumps({"intent": "complaint" if text.endswith("1") else "question"})
        return score
    return factory


def test_scorer(spark, tmp_path):
    df = spark.createDataFrame(POSTS, "_seq long, text_clean string, keep_for_analysis boolean")
    calls = tmp_path / "calls"
    calls.mkdir()
    out = classify.classify_scored(
        df, scorer_factory(str(calls)), parallelism=2, answers_path=str(tmp_path / "answers"),
        hot_rows=4)
    rows = out.orderBy("_seq").collect()
    assert out.orderBy("_seq").collect() == rows
    for (_, text, kept), row in zip(POSTS, rows):
        if not kept:
            assert row.intent == "unknown" and row.llm_explanation == ""
        elif text.endswith("3"):
            assert row.intent == "other"
            assert row.llm_explanation == fixed.FAILED_CALL + "service indisponible"
        else:
            assert row.intent == ("complaint" if text.endswith("1") else "question")
    # Each distinct text once, the scorer once per task, and nothing again on reuse.
    assert len(list(calls.glob("call-*"))) == 5
    assert len(list(calls.glob("start-*"))) <= 2
    assert out.columns == [*df.columns, *classify.VERDICT_COLUMNS]


def test_pause_between_calls(spark):
    import time
    texts = spark.createDataFrame([(str(i),) for i in range(4)], "text string")
    start = time.perf_counter()
    assert classify.score_texts(texts, lambda: str.upper, 1, pause=0.2).count() == 4
    assert time.perf_counter() - start >= 0.8


@pytest.mark.parametrize("limit", [None, 0, 1, 7, 29, 30, 31, 1000])
@pytest.mark.parametrize("ranges", [20, 200, 1 << 16])
def test_cap(spark, monkeypatch, limit, ranges):
    monkeypatch.setattr(classify, "CAP_RANGES", ranges)
    # Positions far apart and close together.
    rows = [(i * 3 if i < 25 else 10**6 + i, i % 4 != 0) for i in range(40)]
    df = spark.createDataFrame(rows, "_seq long, keep_for_analysis boolean").coalesce(2)
    out = classify.cap_kept(df, limit).orderBy("_seq").collect()
    left = len(rows) if limit is None else limit
    for (seq, kept), row in zip(rows, out):
        assert (row._seq, row.keep_for_analysis) == (seq, kept and left > 0)
        left -= kept


@pytest.mark.parametrize("limit", [1, 6, 7, 8, 20, 21, 60])
def test_cap_of_repeated_positions(spark, limit):
    rows = [(i // 20, f"{i % 20:02}", True) for i in range(60)]
    df = spark.createDataFrame(rows, "_seq long, id string, keep_for_analysis boolean")
    out = classify.cap_kept(df, limit, tie="id").where("keep_for_analysis")
    assert sorted((r._seq, r.id) for r in out.collect()) == [(s, i) for s, i, _ in rows[:limit]]
    if limit % 20:
        with pytest.raises(ValueError):
            classify.cap_kept(df, limit)
        with pytest.raises(ValueError):
            classify.cap_kept(df.withColumn("id", F.lit("x")), limit, tie="id")
        with pytest.raises(ValueError):
            classify.cap_kept(df.withColumn("id", F.lit(None).cast("string")), limit, tie="id")


def test_cap_needs_positions(spark):
    df = spark.createDataFrame([(None, True)], "_seq long, keep_for_analysis boolean")
    with pytest.raises(ValueError):
        classify.cap_kept(df, 3)


def test_repeated_answers_leave_the_row_count(spark):
    df = spark.createDataFrame([(0, "1", True), (1, "1", True), (2, "2", True)],
                               "_seq long, id string, keep_for_analysis boolean")
    stored = spark.createDataFrame(
        [(5, "1", '{"intent":"praise"}'), (3, "1", '{"intent":"question"}'), (4, "2", None)],
        "_seq long, id string, llm_response string")
    out = classify.classify_stored(df, stored).orderBy("_seq").collect()
    assert [r.intent for r in out] == ["question", "question", "other"]
    unordered = classify.classify_stored(df, stored.drop("_seq")).orderBy("_seq").collect()
    assert [r.intent for r in unordered] == ["praise", "praise", "other"]


def test_answers_are_kept_between_runs(spark, tmp_path):
    df = spark.createDataFrame(POSTS, "_seq long, text_clean string, keep_for_analysis boolean")
    calls = tmp_path / "calls"
    calls.mkdir()

    def run(rows, **options):
        out = classify.classify_scored(rows, scorer_factory(str(calls)), parallelism=2,
                                       answers_path=str(tmp_path / "answers"), **options)
        return {r._seq: (r.intent, r.llm_explanation) for r in out.collect()}

    part = run(df.where("text_clean < 'free 2'"))
    assert len(list(calls.glob("call-*"))) == 2
    # What is missing is asked about.
    whole = run(df, task_texts=1)
    assert len(list(calls.glob("call-*"))) == 5
    assert part.items() <= whole.items()
    # Again, and for a part of the rows: no call, nothing lost.
    assert run(df) == whole and run(df.where("_seq = 1")) == {1: whole[1]}
    assert run(df) == whole and len(list(calls.glob("call-*"))) == 5
    # Failed calls are made again on request only.
    assert run(df, retry_failed=True) == whole and len(list(calls.glob("call-*"))) == 6


def test_nothing_to_ask(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True), (2, "x", False)],
                               "_seq long, text_clean string, keep_for_analysis boolean")
    out = classify.classify_scored(df, scorer_factory(str(tmp_path)), parallelism=1)
    assert sorted((r._seq, r.intent) for r in out.collect()) == [(1, "other"), (2, "unknown")]
    assert not list(tmp_path.glob("call-*"))


def test_calls_per_second_hold_for_all_tasks(spark):
    import time
    texts = spark.createDataFrame([(str(i),) for i in range(4)], "text string")
    start = time.perf_counter()
    assert classify.score_texts(texts, lambda: str.upper, 2, per_second=4).count() == 4
    assert time.perf_counter() - start >= 0.5


def test_client_gets_both_parts_of_the_prompt():
    score = classify.prompted(lambda: lambda role, request: f"{role}|{request}")()
    role, request = score("ma box").split("|", 1)
    assert role == classify.PROMPT_ROLE and "ma box" in request


def test_cap_of_nothing(spark):
    df = spark.createDataFrame([(1, False)], "_seq long, keep_for_analysis boolean")
    assert classify.cap_kept(df, 3).first().keep_for_analysis is False


def test_prompt_holds_the_text_and_the_domains(spark):
    df = spark.createDataFrame([("free {x} \"y\"",), (None,)], "t string")
    first, second = [r[0] for r in df.select(classify.prompt(F.col("t"))).collect()]
    assert 'free {x} "y"' in first and second
    for word in (*fixed.INTENTS, *fixed.COMPLAINT_TYPES, *fixed.SENTIMENTS, *fixed.PRIORITIES):
        assert word in first


def test_a_failing_call_is_tried_again(spark, tmp_path):
    """The scorer fails twice on each text: two retries get the answer, one does not."""
    def factory():
        def score(text):
            seen = tmp_path / f"{text}-{len(list(tmp_path.glob(f'{text}-*')))}"
            seen.touch()
            if len(list(tmp_path.glob(f"{text}-*"))) < 3:
                raise RuntimeError("busy")
            return text
        return score

    texts = spark.createDataFrame([("a",), ("b",)], "text string")
    first = classify.score_texts(texts, factory, 2, retries=1, backoff=0.01).collect()
    assert {(r.answer, r.error) for r in first} == {(None, "busy")}
    second = classify.score_texts(texts, factory, 2, retries=2, backoff=0.01).collect()
    assert {(r.text, r.answer, r.error) for r in second} == {("a", "a", None), ("b", "b", None)}


def test_more_tasks_than_cores_share_one_rate(spark):
    import time
    texts = spark.createDataFrame([(str(i),) for i in range(32)], "text string")
    start = time.perf_counter()
    assert classify.score_texts(texts, lambda: str.upper, 32, per_second=32).count() == 32
    # 32 calls at 32 a second; dealt by task instead of core, they would have taken 4 s.
    assert 0.9 <= time.perf_counter() - start < 3.5


def test_answers_of_finished_tasks_outlive_the_job(spark, tmp_path):
    """One task dies after the others have ended: their answers are kept, and a file belongs to a task."""
    import time

    def factory():
        def score(text):
            if text == "0":
                time.sleep(4)
                raise SystemExit
            return text
        return score

    texts = spark.createDataFrame([(str(i),) for i in range(8)], "text string")
    path = str(tmp_path / "answers")
    with pytest.raises(Exception):
        classify.answer_texts(texts, factory, path, parallelism=8)
    known = classify.stored_texts(spark, path).count()
    assert known >= 5
    assert classify.answer_texts(texts, lambda: str.upper, path, parallelism=8) == 8 - known
    assert classify.stored_texts(spark, path).count() == 8
    assert len(list((tmp_path / "answers").glob("part-*"))) <= 16


def test_scored_stream(spark, tmp_path):
    """Each text is asked about once; a micro-batch that runs again calls nothing and writes nothing twice."""
    from custvoice.streaming import enrich_stream
    columns = "_seq long, id string, created_at string, full_text string, screen_name string"
    rows = [(i, str(i), None, f"free {i % 6}" if i % 4 else "rien", "client") for i in range(24)]
    source, calls = str(tmp_path / "in"), tmp_path / "calls"
    calls.mkdir()
    spark.createDataFrame(rows[:12], columns).repartition(3).write.parquet(source)

    def run():
        raw = enrich_stream.read_raw_stream(spark, source, files_per_batch=1)
        query = enrich_stream.write_scored_stream(
            raw, scorer_factory(str(calls)), str(tmp_path / "answers"), str(tmp_path / "out"),
            str(tmp_path / "check"), once=True, parallelism=2)
        assert query.awaitTermination(300)
        return enrich_stream.read_scored_stream(spark, str(tmp_path / "out"))

    first = run()
    assert first.count() == 12 and {r["batch"] for r in first.collect()} == {0, 1, 2}
    asked = {r[3] for r in rows[:12] if r[3] != "rien"}
    assert len(list(calls.glob("call-*"))) == len(asked)
    spark.createDataFrame(rows[12:], columns).coalesce(1).write.mode("append").parquet(source)
    second = run()
    every = len({r[3] for r in rows if r[3] != "rien"})
    assert second.count() == 24 and len(list(calls.glob("call-*"))) == every
    # The last micro-batch again, as after a stop between its write and its commit.
    before = sorted(map(str, second.collect()))
    for f in (tmp_path / "check" / "commits").glob("*3*"):
        f.unlink()
    again = run()
    assert len(list(calls.glob("call-*"))) == every and again.count() == 24
    assert sorted(map(str, again.collect())) == before


@pytest.mark.parametrize("wanted", [1, 5, 40, 79, 80, 100])
def test_nth_smallest(spark, monkeypatch, wanted):
    monkeypatch.setattr(classify, "CAP_RANGES", 7)
    values = [None] * 3 + [f"{i * 7919 % 97:03}" for i in range(97)]
    df = spark.createDataFrame([(v,) for v in values], "tie string").repartition(5)
    expected = sorted(values, key=lambda v: (v is not None, v))[wanted - 1]
    assert classify._nth_smallest(df, wanted) == expected


def test_rows_not_kept_are_not_joined(spark):
    """Rows that are not kept take no part in the lookup, whose kept side alone is read for it."""
    rows = [(i, str(i % 5) if i % 7 else None, "free", i % 3 == 0 if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "_seq long, id string, text_clean string, keep_for_analysis boolean")
    stored = spark.createDataFrame([(k, str(k), '{"intent":"thanks"}') for k in range(4)], "_seq long, id string, llm_response string")
    got = classify.classify_stored(df, stored)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.index("Union") < plan.index("Join")
    found = {r["_seq"]: r["intent"] for r in got.collect()}
    assert len(found) == 40
    for seq, key, _, keep in rows:
        assert (found[seq] == "thanks") == bool(keep and key in {"0", "1", "2", "3"})
        assert (found[seq] == "unknown") >= (not keep)


def test_micro_batches_take_all_cores(spark, tmp_path, monkeypatch):
    """A micro-batch of one file is prepared by as many tasks as there are cores."""
    from custvoice.streaming import enrich_stream
    columns = "_seq long, id string, created_at string, full_text string, screen_name string"
    rows = [(i, str(i), None, f"free {i % 6}", "client") for i in range(24)]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, prepare = [], enrich_stream.prepare
    monkeypatch.setattr(enrich_stream, "prepare", lambda df, config: (seen.append(df.rdd.getNumPartitions()), prepare(df, config))[1])
    raw = enrich_stream.read_raw_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    enrich_stream.write_scored_stream(raw, lambda: str, *(str(tmp_path / n) for n in ("answers", "out", "checkpoint")), once=True).awaitTermination()
    assert seen and min(seen) >= spark.sparkContext.defaultParallelism
