"""Quality rules as a ledger of bits.

Every rule is evaluated once for every document.  The ledger keeps the measurements
and one integer whose bit ``i`` says that rule ``i`` failed, so policies (which bits
reject) can change, and what each rule alone contributes can be counted, without
reading a text again.

Defined results: a null or empty text has no words; repeated rows are judged each;
an empty table gives an empty ledger; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.llm.store import only
from custvoice.llm.words import SPACE, Words, hash_spans, mix, per_text, runs

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_bullets", "max_word_bytes")


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of a run of texts."""
    w = Words(data, offsets)
    head = (data & 0xC0) != 0x80
    size = np.diff(offsets)
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    lengths = w.ends - w.starts
    symbols = _SYMBOL[data]
    # Words in a window of three that the text holds twice or more.
    grams, at = w.shingles(w.hashes(), 3)
    keyed = grams ^ mix(w.doc()[at].astype(np.uint64)) if len(at) else grams
    ordered = np.sort(keyed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    covered = np.zeros(len(w) + 3, bool)
    if len(twice):
        place = np.minimum(np.searchsorted(twice, keyed), len(twice) - 1)
        hit = at[twice[place] == keyed]
        for k in range(3):
            covered[hit + k] = True
    covered = covered[: len(w)]
    # Lines with a word, equal to an earlier one of the same text.
    lines = Words(data, offsets, _LINE)
    words_before = np.concatenate(([0], np.cumsum(w.inside)))
    real = words_before[lines.ends] > words_before[lines.starts]
    doc = lines.doc()[real]
    key = hash_spans(data, lines.starts[real], lines.ends[real]) ^ mix(doc.astype(np.uint64))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    n_lines = np.bincount(doc, minlength=len(size))
    longest = np.zeros(len(size), np.int64)
    np.maximum.at(longest, w.doc(), lengths)
    opening = data[lines.starts[real]] if len(doc) else np.zeros(0, np.uint8)
    return {
        "n_words": w.counts, "word_chars": per_text((head & w.inside).astype(np.int64), size),
        "n_symbols": per_text(symbols.astype(np.int64), size),
        "n_dup_lines": np.bincount(doc[~first], minlength=len(size)),
        "n_repeat_words": per_text(covered.astype(np.int64), w.counts),
        "n_lines": n_lines,
        "n_alpha_words": per_text((letters[w.ends] > letters[w.starts]).astype(np.int64), w.counts),
        "n_bullets": np.bincount(doc[np.isin(opening, list(b"-*"))], minlength=len(size)),
        "max_word_bytes": longest,
    }


# Bytes of texts that are measured at a time: the arrays made of them are some fifty times as large.
MEASURED = 1 << 18


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if "text" not in batch.schema.names:
            batch = batch.append_column("text", batch.column("row").field("text"))
        for rows, data, offsets in runs(batch, size=MEASURED):
            found = measure(data, offsets)
            columns = [pa.array(found[m].astype(np.int64)) for m in MEASURES]
            kept = [rows.column(i) for i, name in enumerate(rows.schema.names) if name != "text"]
            names = [name for name in rows.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, *MEASURES])


@dataclass(frozen=True)
class Rule:
    name: str
    failed: Column


def rules() -> list[Rule]:
    """The rules in the order of their bits; a rule once released keeps its bit."""
    c, per = F.col, lambda a, b: F.col(a) * 100 > b
    words = c("n_words")
    return [
        Rule("few_words", words < 50),
        Rule("repeats", per("n_repeat_words", 50 * words)),
        Rule("symbols", per("n_symbols", 30 * words)),
        Rule("dup_lines", (c("n_lines") > 3) & per("n_dup_lines", 60 * c("n_lines"))),
        Rule("mean_word", (words > 0) & ((c("word_chars") < 2 * words) | (c("word_chars") > 20 * words))),
        Rule("few_alpha", c("n_alpha_words") * 100 < 60 * words),
        Rule("bullets", (c("n_lines") > 3) & per("n_bullets", 90 * c("n_lines"))),
        Rule("many_words", words > 50_000_000),
    ]


@dataclass(frozen=True)
class Policy:
    """Which failed rules reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        order = [r.name for r in rules()]
        return sum(1 << order.index(name) for name in self.rules)


BASE = Policy("base", ("few_words", "repeats"))
STRICT = Policy("v1", ("few_words", "repeats", "symbols", "dup_lines", "mean_word", "few_alpha", "bullets"))
POLICIES = {p.version: p for p in (BASE, STRICT)}


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, all measurements, and ``failed_bits``: one row for each row of ``docs``."""
    plain = only(docs, doc_id="bigint", text="string")
    schema = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
    bits = sum((F.when(rule.failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules())), F.lit(0))
    return plain.mapInArrow(_measure_batches, schema).withColumn("failed_bits", bits.cast("bigint"))


def apply_policy(book: DataFrame, policy: Policy) -> Column:
    """Whether a row of the ledger stays under the policy."""
    return book["failed_bits"].bitwiseAND(F.lit(policy.mask)) == 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many it alone rejects.

    One pass of bitwise aggregation over the ledger; no text is read.
    """
    order = [r.name for r in rules()]
    hit = book.select(book["failed_bits"].bitwiseAND(F.lit(policy.mask)).alias("bits")).groupBy("bits").count()
    parts = [
        hit.agg(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << order.index(name))) != 0, F.col("count"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == 1 << order.index(name), F.col("count"))), F.lit(0)).alias("only_this"),
        )
        for name in policy.rules
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def filter_quality(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns.

    The rules run beside the text in one pass, so no join is needed and repeated
    ids cannot multiply rows.  A text is handed to Python once, as part of its row.
    """
    names = docs.columns
    inner = docs.select(F.struct(*(docs[n] for n in names)).alias("row"))
    if ("text", "string") not in docs.dtypes:
        inner = docs.select(F.struct(*(docs[n] for n in names)).alias("row"), docs["text"].cast("string").alias("text"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    book = inner.mapInArrow(_measure_batches, schema)
    bits = sum((F.when(rule.failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules())), F.lit(0))
    return book.where(bits.bitwiseAND(F.lit(policy.mask)) == 0).select("row.*")
