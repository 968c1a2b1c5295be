"""Classification of the kept posts: prompt, answers, defaults.

An answer is the text a classifier returned.  It comes from a table of stored
answers, or from a scorer that runs over the distinct texts in Arrow batches.  Its
answers are appended to a table as each task ends, and a text that table holds is
never asked about again: a stopped run goes on where it ended.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custvoice import fixed_values as fixed
from custvoice.fixed_values import COMPLAINT_TYPES, INTENTS, PRIORITIES, SENTIMENTS
from custvoice.fixed_values import TRUE_WORDS_SHORT
from custvoice.functions.values import parse_bool
from custvoice.operators.lookup import first_per_key, lookup_join
from custvoice.schema import SEQ
from custvoice.session import scratch_dir
from custvoice.sources.tables import path_exists, remove

# text -> answer; made once per task by a factory.
Scorer = Callable[[str], str]

VERDICT_COLUMNS = (
    "intent", "complaint_type", "sentiment", "sarcasm", "priority", "llm_explanation",
)

_ANSWER = (
    "intent string, complaint_type string, sentiment string, sarcasm string, "
    "priority string, explanation string, _corrupt_record string"
)

NO_ANSWER = "no answer"
NOT_AN_OBJECT = "the answer is not a JSON object"

PROMPT_ROLE = (
    "Vous êtes chargé de trier les messages publics adressés au service client "
    "d'un opérateur télécom."
)
PROMPT_HEAD = "Classez ce message de client.\n\nMESSAGE :\n"
PROMPT_TAIL = (
    "\n\nRépondez par un seul objet JSON avec ces champs :\n"
    f'"intent" : {" | ".join(INTENTS)}\n'
    f'"complaint_type" : {" | ".join(COMPLAINT_TYPES)} (none hors plainte)\n'
    f'"sentiment" : {" | ".join(SENTIMENTS)}\n'
    '"sarcasm" : true | false\n'
    f'"priority" : {" | ".join(PRIORITIES)} (none hors plainte)\n'
    '"explanation" : une phrase courte\n'
)


def prompted(client: Callable[[], Callable[[str, str], str]]) -> Callable[[], Scorer]:
    """A scorer factory from one of clients that take the two parts of the prompt, role and request."""
    def factory() -> Scorer:
        call = client()
        return lambda text: call(PROMPT_ROLE, f"{PROMPT_HEAD}{text}{PROMPT_TAIL}")

    return factory


def prompt(text: Column) -> Column:
    """The user prompt for one post."""
    return F.concat(F.lit(PROMPT_HEAD), F.coalesce(text, F.lit("")), F.lit(PROMPT_TAIL))


def with_parsed(df: DataFrame, answer: Column, error: Column | None = None) -> DataFrame:
    """Add the six verdict columns of a classifier's answer.

    The JSON object is looked for between the first and the last brace, so prose
    around it does no harm.  Missing fields and nulls get defaults.  An answer
    that cannot be read, a whole answer that is JSON but no object, and a failed
    call (``error``) give the default verdict and say why.

    Each step is a projection of its own, so that an answer is searched and parsed once.
    """
    error = F.lit(None).cast("string") if error is None else error
    body, fields, failed = F.col("_body"), F.col("_fields"), F.col("_failed")
    # The parser stops at the end of the first object; counting the elements of
    # "[body]" reads all of it, but lets single quotes pass, which the parser does not.
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    steps = df.withColumns({
        "_body": F.regexp_extract(answer, r"(?s)\{.*\}", 0),
        "_failed": F.coalesce(
            error,
            F.when(answer.isNull(), NO_ANSWER),
            F.when(F.json_array_length(answer).isNotNull(), NOT_AN_OBJECT),
        ),
    })
    steps = steps.withColumn("_fields", F.from_json(body, _ANSWER, {"allowSingleQuotes": "false"}))
    steps = steps.withColumn("_sound", F.coalesce(
        whole & (body != "") & fields["_corrupt_record"].isNull(), F.lit(False)
    ))
    sound = F.col("_sound")
    readable = failed.isNull() & sound

    def field(name: str, default: str) -> Column:
        return F.when(readable, F.coalesce(fields[name], F.lit(default))).otherwise(default)

    unparsed = F.concat(
        F.lit(fixed.UNPARSED_RESPONSE),
        F.substring(answer, 1, fixed.UNPARSED_RESPONSE_CHARS),
        F.lit("..."),
    )
    return steps.withColumns({
        "intent": field("intent", "other"),
        "complaint_type": field("complaint_type", "none"),
        "sentiment": field("sentiment", "neutral"),
        "sarcasm": readable & parse_bool(fields["sarcasm"], TRUE_WORDS_SHORT),
        "priority": field("priority", "none"),
        "llm_explanation": F.when(failed.isNotNull(), F.concat(F.lit(fixed.FAILED_CALL), failed))
        .when(sound, F.coalesce(fields["explanation"], F.lit("")))
        .otherwise(unparsed),
    }).drop("_body", "_fields", "_failed", "_sound")


def with_verdict(df: DataFrame, keep_col: str, answer_col: str, error_col: str | None) -> DataFrame:
    """Verdict columns from the answer of kept rows; other rows stay ``unknown``."""
    keep = F.coalesce(F.col(keep_col), F.lit(False))
    parsed = with_parsed(df, F.col(answer_col), F.col(error_col) if error_col else None)
    unsent = {
        "intent": "unknown", "complaint_type": "none", "sentiment": "neutral",
        "sarcasm": False, "priority": "none", "llm_explanation": "",
    }
    return parsed.withColumns({
        name: F.when(keep, F.col(name)).otherwise(F.lit(unsent[name]))
        for name in VERDICT_COLUMNS
    })


def classify_stored(
    df: DataFrame,
    answers: DataFrame,
    keep_col: str = "keep_for_analysis",
    id_col: str = "id",
    answer_col: str = "llm_response",
    order: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Verdicts from stored answers ``(id, answer)``.

    Of several answers to an id the first by ``order`` counts: the file position
    by default, or where there is none the answer itself.  Only kept rows take
    part in the join.  ``df`` may be a stream.
    """
    order = order or (SEQ if SEQ in answers.columns else answer_col)
    stored = first_answers(answers, order, id_col, answer_col)
    stored = stored.select(F.col(id_col).alias("_post"), F.col(answer_col).alias("_answer"))
    asked = df.withColumn("_post", F.when(F.col(keep_col), F.col(id_col)))
    joined = _lookup_kept(asked, stored, "_post", keep_col, hot_rows)
    return with_verdict(joined, keep_col, "_answer", None).drop("_post", "_answer")


def _lookup_kept(asked: DataFrame, answers: DataFrame, key: str, keep_col: str, hot_rows: int | None) -> DataFrame:
    """``asked`` with the answer of each kept row; the others stay where they are and are not shuffled."""
    if asked.isStreaming:
        return lookup_join(asked, answers, key, spread=SEQ, hot_rows=hot_rows)
    keep = F.coalesce(F.col(keep_col), F.lit(False))
    kept = lookup_join(asked.where(keep), answers, key, spread=SEQ, hot_rows=hot_rows)
    rest = asked.where(~keep)
    found = {f.name: F.lit(None).cast(f.dataType) for f in answers.schema if f.name != key}
    return kept.unionByName(rest.withColumns(found))


def first_answers(
    answers: DataFrame, order: str = SEQ, id_col: str = "id", answer_col: str = "llm_response"
) -> DataFrame:
    """One stored answer per id, the first by ``order``."""
    return first_per_key(answers, id_col, order, [answer_col])


# Distinct texts a scoring task gets, and so the most that a lost task asks again.
TASK_TEXTS = 10_000
# More tasks, and so files of answers, than this a run does not make.
TASKS_LIMIT = 100_000


def score_texts(
    texts: DataFrame,
    factory: Callable[[], Scorer],
    parallelism: int | None = None,
    pause: float = 0.0,
    per_second: float | None = None,
    retries: int = 0,
    backoff: float = 1.0,
) -> DataFrame:
    """``(text, answer, error)`` for a table of distinct ``text``.

    The scorer is made once per task.  A text it fails on is tried ``retries`` times
    more, after ``backoff`` seconds and twice as long each time; then it gets the error,
    and the rest go on.  ``parallelism`` sets the number of tasks, by default one per core
    or shuffle partition: adaptive execution would put many short texts into one
    task, and a slow scorer would wait there.  ``pause`` waits after each call.

    ``per_second`` is the most calls a second of all tasks together.  It is shared out
    among the tasks that can run at a time, one for each core, however many tasks there
    are: each leaves so much time from the start of a call to the next one's, also
    after its last call, as its core's next task begins then.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    if parallelism is None:
        parallelism = max(cores, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    interval = min(parallelism, cores) / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()

        def ask(text: str) -> tuple[str | None, str | None]:
            error = None
            for attempt in range(retries + 1):
                if error is not None:
                    time.sleep(backoff * 2 ** (attempt - 1))
                start = time.monotonic()
                answer = error = None
                try:
                    answer = scorer(text)
                except Exception as exc:  # noqa: BLE001 - any failure is this row's verdict
                    error = str(exc)
                rest = max(pause, interval - (time.monotonic() - start))
                if rest > 0:
                    time.sleep(rest)
                if error is None:
                    break
            return answer, error

        for batch in batches:
            told = [ask(text) for text in batch["text"]]
            answers, errors = [a for a, _ in told], [e for _, e in told]
            yield pd.DataFrame({"text": batch["text"], "answer": answers, "error": errors})

    asked = texts.repartition(parallelism)
    return asked.mapInPandas(run, "text string, answer string, error string")


_SCORED = "_text string, _answer string, _error string"


def answer_texts(
    texts: DataFrame,
    factory: Callable[[], Scorer],
    path: str,
    parallelism: int | None = None,
    task_texts: int = TASK_TEXTS,
    retry_failed: bool = False,
    **options: float | None,
) -> int:
    """Append the answers to the distinct ``text`` that the table at ``path`` lacks; how many were asked for.

    One job asks for all of them, a task for some ``task_texts``.  A task's answers are
    in place as soon as it is finished, whatever becomes of the job; asked again, a
    text gives one more row, of which readers take one.
    """
    spark = texts.sparkSession
    digest = F.sha2("text", 256)
    open_texts = texts.where("text is not null").distinct().withColumn("_text", digest)
    if path_exists(spark, path):
        known = spark.read.schema(_SCORED).parquet(path)
        if retry_failed:
            known = known.where("_error is null")
        open_texts = open_texts.join(known.select("_text"), "_text", "left_anti")
    # What is asked is fixed before the first call.
    asked_path = scratch_dir(spark, "asked")
    open_texts.select("text").write.parquet(asked_path)
    asked = spark.read.schema("text string").parquet(asked_path)
    many = asked.count()
    if many:
        cores = spark.sparkContext.defaultParallelism
        tasks = parallelism or min(max(cores, -(-many // task_texts)), TASKS_LIMIT, many)
        scored = score_texts(asked, factory, tasks, **options)
        columns = [digest.alias("_text"), F.col("answer").alias("_answer"), F.col("error").alias("_error")]
        # This committer moves files when a task ends, not when the job does.
        at_task_end = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
        scored.select(columns).write.options(**at_task_end).mode("append").parquet(path)
    remove(spark, asked_path)
    return many


def stored_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(_text, _answer, _error)`` per text that the table at ``path`` answers; an answer counts before an error."""
    rows = (spark.read.schema(_SCORED).parquet(path) if path_exists(spark, path)
            else spark.createDataFrame([], _SCORED))
    best = F.min(F.struct(F.col("_error").isNotNull().alias("late"), "_answer", "_error"))
    return rows.groupBy("_text").agg(best.alias("_row")).select("_text", "_row._answer", "_row._error")


def classify_scored(
    df: DataFrame,
    factory: Callable[[], Scorer],
    text_col: str = "text_clean",
    keep_col: str = "keep_for_analysis",
    parallelism: int | None = None,
    pause: float = 0.0,
    answers_path: str | None = None,
    per_second: float | None = None,
    task_texts: int = TASK_TEXTS,
    retry_failed: bool = False,
    hot_rows: int | None = None,
    retries: int = 0,
    backoff: float = 1.0,
) -> DataFrame:
    """Verdicts from a scorer, called once per distinct text of the kept rows.

    The answers are appended to ``answers_path`` (a fresh scratch folder by
    default), task by task, and joined by a digest of the text.  Texts that folder
    already answers are not asked about again, nor those on which the call failed
    unless ``retry_failed``.  A stopped run loses the tasks it was in.
    """
    spark = df.sparkSession
    path = answers_path or scratch_dir(spark, "answers")
    texts = df.where(F.col(keep_col)).select(F.col(text_col).alias("text"))
    answer_texts(texts, factory, path, parallelism, task_texts, retry_failed,
                 pause=pause, per_second=per_second, retries=retries, backoff=backoff)
    asked = df.withColumn("_text", F.when(F.col(keep_col), F.sha2(text_col, 256)))
    joined = _lookup_kept(asked, stored_texts(spark, path), "_text", keep_col, hot_rows)
    return with_verdict(joined, keep_col, "_answer", "_error").drop("_text", "_answer", "_error")


# The cap looks for its last position in at most this many ranges at a time, until
# a range is a single position.
CAP_RANGES = 1 << 16


def cap_kept(
    df: DataFrame,
    limit: int | None,
    keep_col: str = "keep_for_analysis",
    order: str = SEQ,
    tie: str | None = None,
) -> DataFrame:
    """Keep the flag on the first ``limit`` flagged rows in file order, clear it on the rest.

    The cap becomes one number, the last file position that stays flagged, so no
    row is moved and the number can be pushed down to the scan.  Where the cap falls
    among rows of one position, ``tie`` has to tell them apart; without it, or where
    it does not, the cap is refused.
    """
    if limit is None:
        return df
    if limit <= 0:
        return df.withColumn(keep_col, F.lit(False))
    flagged = df.where(F.col(keep_col))
    last, among = _last_position(flagged.select(F.col(order).alias("at")), limit)
    if last is None:
        return df
    kept = F.col(order) <= last
    if among:
        if tie is None:
            raise ValueError(f"the cap falls among rows of position {last}: name a second key")
        shared = flagged.where(F.col(order) == last).select(F.col(tie).alias("tie"))
        bound = _nth_smallest(shared, among)
        if bound is None or shared.where(F.col("tie").isNull() | (F.col("tie") <= bound)).count() != among:
            raise ValueError(f"{tie} does not tell the rows of position {last} apart")
        kept = (F.col(order) < last) | ((F.col(order) == last) & (F.col(tie) <= bound))
    return df.withColumn(keep_col, F.col(keep_col) & F.coalesce(kept, F.lit(False)))


def _nth_smallest(ties: DataFrame, wanted: int) -> object:
    """The ``wanted``-th smallest ``tie``, nulls first; no task or driver gets more than a range of them."""
    if ties.where("tie is null").limit(wanted).count() == wanted:
        return None
    wanted -= ties.where("tie is null").count()
    ties = ties.where("tie is not null")
    while True:
        ranges = ties.repartitionByRange("tie").groupBy(F.spark_partition_id().alias("range")).agg(
            F.min("tie").alias("low"), F.max("tie").alias("high"), F.count(F.lit(1)).alias("rows"))
        found = sorted(ranges.collect(), key=lambda r: r["range"])
        for r in found:
            if wanted <= r["rows"]:
                break
            wanted -= r["rows"]
        if r["rows"] <= CAP_RANGES or r["low"] == r["high"] or len(found) == 1:
            shared = ties.where(F.col("tie").between(r["low"], r["high"]))
            return shared.orderBy("tie").limit(wanted).agg(F.max("tie")).first()[0]
        ties = ties.where(F.col("tie").between(r["low"], r["high"]))


def _last_position(flagged: DataFrame, wanted: int) -> tuple[int | None, int]:
    """The ``wanted``-th smallest position, or None if there are not as many.

    Positions are counted per range, the range in which the count reaches the
    wanted number is cut into ranges again, down to one position.  If more rows are
    there than wanted, the second value says how many of them are.
    """
    low, high, unplaced = flagged.agg(
        F.min("at"), F.max("at"), F.count_if(F.col("at").isNull())
    ).first()
    if unplaced:
        raise ValueError("flagged rows without a position cannot be capped")
    while low is not None:
        width = -(-(high - low + 1) // CAP_RANGES)
        ranges = (
            flagged.where(F.col("at").between(low, high))
            .groupBy(F.expr(f"(at - {low}L) DIV {width}L").alias("range"))
            .agg(F.count(F.lit(1)).alias("rows"))
        )
        upto = F.sum("rows").over(Window.orderBy("range"))
        reached = (
            ranges.withColumn("upto", upto).where(F.col("upto") >= wanted).orderBy("range").first()
        )
        if reached is None:
            break
        wanted -= reached["upto"] - reached["rows"]
        low += reached["range"] * width
        high = min(low + width - 1, high)
        if width == 1:
            return low, wanted if wanted < reached["rows"] else 0
    return None, 0
