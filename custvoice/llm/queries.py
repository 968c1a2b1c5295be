"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvoice.llm import copies, decontaminate, eliasfano, kneser_ney, licenses, merkle, packing, pages, passages, periodic, quality, setjoin, tokens, toxicity
from custvoice.llm.store import read


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(read(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.apply_policy(book, quality.BASE)).alias("base_failed"),
        quality.apply_policy(book, quality.STRICT).alias("kept"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, usable=lambda doc_id: ~toxicity.held_out(doc_id) & doc_id.isNotNull())
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~kneser_ney.held_out(F.col("doc_id"))))
    scored = kneser_ney.score(docs, model)
    return scored.withColumn("held_out", kneser_ney.held_out(F.col("doc_id")))


def op4_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.encode_corpus(read(spark, sf_dir, "documents"), tokens.vocabulary(), end_id=2)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op7_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.component_ids(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokens.vocabulary(), end_id=1)


def _echoed(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a hash of its id, repeats a stretch of its words from some word on, as many words as before."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select("doc_id", "text", h.alias("h"), F.when((h % 10 == 0), words).alias("words"))
    marked = marked.select("*", F.size("words").alias("n"), F.expr("h div 10").alias("g"))
    marked = marked.withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    marked = marked.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    echo = F.expr("slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), int((n - a + p - 1) div p)))), 1, n)")
    return marked.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", echo)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_echoed(read(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    told = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(read(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"), suspect=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_passages, op3_kneser_ney, op4_elias_fano, op5_licenses, op6_main_text, op7_set_join, op8_decontamination, op9_packing, op10_quality,
                                   op11_periodic_runs, op12_exact_copies, op13_manifest)}
