"""Toxicity by a linear classifier that is regularised with counterfactuals.

A text's features are the distinct words it holds and the distinct beginnings of its
words, hashed.  Words name insults; beginnings catch inflected ones.  The classifier
is logistic, over the features that tell the classes apart best.

Counterfactual regularisation: in every labelled sentence that mentions a group, the
mention is swapped for another of the same kind, and the squared change of the text's
score is added to the loss.  What mentions alone would add to a score is so pressed to
nothing, and a neutral mention of a group does not raise it.

The classifier is fitted on a bounded sample: at most ``EACH`` labelled texts of each
class, those with the smallest hash of their id, shares restored by an offset.  Every
text is scored, whole, in one pass.

Defined results: a null or empty text has the score of a text without known features;
rows without id are never learned from; repeated rows are scored each; without labels
of both classes every score is the share of label 1 among the labels (0.0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.llm.store import only
from custvoice.llm.words import LOWER, Words, distinct, runs

EACH = 5000  # labelled texts of each class to learn from, at most
FEATURES = 1000  # features with a weight, at most
BUCKETS = 1 << 21
STARTS = (3, 4, 5, 6)  # bytes of a word's beginning
THRESHOLD = 0.3
SWAP_PENALTY, RIDGE, STEPS = 10.0, 3.0, 300

# Mentions of groups, by kind.
GROUPS = (
    ("women", "men", "transgender people", "nonbinary people"),
    ("woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False

_NEXT = {term: group[(i + 1) % len(group)] for group in GROUPS for i, term in enumerate(group)}
_MENTION = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")\b", re.IGNORECASE)


def swapped(text: str) -> str:
    """The text with every mention of a group swapped for the next of its kind."""
    return _MENTION.sub(lambda m: _NEXT[m[1].lower()], text)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, text after text, and how many each text has."""
    w = Words(data, offsets, _GAP)
    doc = w.doc()
    kinds, owners = [w.hashes(LOWER)], [doc]
    lengths = w.ends - w.starts
    folded = LOWER[data]
    for n in STARTS:
        long = lengths > n
        kinds.append(_beginnings(folded, w.starts[long], n))
        owners.append(doc[long])
    bucket = np.concatenate(kinds) % np.uint64(BUCKETS)
    key = distinct(np.concatenate(owners).astype(np.uint64) * np.uint64(BUCKETS) + bucket)
    owner = key // np.uint64(BUCKETS)
    return (key % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owner.astype(np.int64), minlength=len(offsets) - 1)


def _beginnings(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` bytes at each start."""
    value = np.full(len(starts), n, np.uint64)
    for k in range(n):
        value = (value + data[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


@dataclass
class Model:
    buckets: np.ndarray  # rising
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if len(self.buckets):
            at = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
            value = np.where(self.buckets[at] == found, self.weights[at], 0.0)
        else:
            value = np.zeros(len(found))
        total = np.concatenate(([0.0], np.cumsum(value)))
        ends = np.cumsum(counts)
        return 1 / (1 + np.exp(-np.clip(total[ends] - total[ends - counts] + self.bias, -30, 30)))


def _learning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in runs(batch):
            found, counts = features(data, offsets)
            parts = np.split(found, np.cumsum(counts)[:-1])
            other = []
            for text in rows["text"].to_pylist():
                changed = swapped(text or "")
                if changed == (text or ""):
                    other.append(None)
                else:
                    raw = np.frombuffer(changed.encode(), np.uint8)
                    other.append(features(raw, np.array([0, len(raw)]))[0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [rows["toxic"], pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(other, pa.binary())], names=["toxic", "found", "swapped"])


def learn(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], each: int = EACH) -> Model:
    """Fit on at most ``each`` labelled texts of each class whose id is ``usable``."""
    known = only(labels, doc_id="bigint", toxic="int").where(F.col("toxic").isin(0, 1) & usable(F.col("doc_id")))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = known.where("false")
    for value in (0, 1):
        sample = sample.unionByName(known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each))
    # At most 2 * each rows of two numbers: small whatever the tables hold.
    sample = F.broadcast(sample.dropDuplicates(["doc_id"]))
    rows = (only(docs, doc_id="bigint", text="string").join(sample, "doc_id")
            .orderBy(F.xxhash64("doc_id")).limit(2 * each)
            .select("toxic", "text").mapInArrow(_learning, "toxic int, found binary, swapped binary").toArrow())
    label = rows["toxic"].to_numpy().astype(np.float64)
    if len(set(label.tolist())) < 2:
        total = sum(shares.values())
        share = shares.get(1, 0) / total if total else 0.0
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    found = [np.frombuffer(x, np.int32) for x in rows["found"].to_pylist()]
    other = [x and np.frombuffer(x, np.int32) for x in rows["swapped"].to_pylist()]
    return fit(label, found, other, shares[1] / shares[0])


def fit(label: np.ndarray, found: list[np.ndarray], other: list[np.ndarray | None], odds: float) -> Model:
    """Logistic regression; ``other`` are the features of the swapped texts, ``odds`` of label 1 outside the sample."""
    count = np.zeros((2, BUCKETS))
    for y in (0, 1):
        chosen = [f for f, v in zip(found, label) if v == y]
        count[y] = np.bincount(np.concatenate(chosen), minlength=BUCKETS)
    n = np.array([(label == 0).sum(), (label == 1).sum()])
    seen = count.sum(axis=0) >= 4
    rate = (count + 0.5) / (n[:, None] + 1)
    strength = np.abs(np.log(rate[1] / rate[0])) / np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))
    strength[~seen] = 0
    best = np.argsort(-strength, kind="stable")[:FEATURES]
    buckets = np.sort(best[strength[best] > 3.5]).astype(np.int32)

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(buckets) + 1), np.float32)
        out[:, -1] = 1
        for i, row in enumerate(rows):
            out[i, np.searchsorted(buckets, np.intersect1d(row, buckets, assume_unique=True))] = 1
        return out

    x = matrix(found)
    pairs = [(f, o) for f, o in zip(found, other) if o is not None]
    change = matrix([f for f, _ in pairs]) - matrix([o for _, o in pairs]) if pairs else np.zeros((0, x.shape[1]), np.float32)
    ridge = np.full(x.shape[1], RIDGE, np.float32)
    ridge[-1] = 0
    w = np.zeros(x.shape[1], np.float32)
    speed = w.copy()
    bound = 0.25 * _norm(x) + RIDGE + SWAP_PENALTY * _norm(change)
    for step in range(STEPS):
        ahead = w + speed * (step / (step + 3))
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (p - label).astype(np.float32) + ridge * ahead + SWAP_PENALTY * (change.T @ (change @ ahead))
        new = ahead - slope / np.float32(bound)
        speed, w = new - w, new
    bias = float(w[-1]) + float(np.log(odds) - np.log(n[1] / n[0]))
    return Model(buckets, w[:-1].astype(np.float64), bias)


def _norm(x: np.ndarray) -> float:
    """The largest eigenvalue of ``x.T @ x``, a little above."""
    if not len(x):
        return 0.0
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        u = x.T @ (x @ v)
        size = float(np.linalg.norm(u))
        if not size:
            return 0.0
        v = u / size
    return 1.1 * size


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for each row of ``docs``; the model is some thousand numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in runs(batch):
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(model.score(*features(data, offsets)))], names=["doc_id", "score"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: the checksum of its id leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
