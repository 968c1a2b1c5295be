"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame functions alone.

The partitions that read the documents are the leaves of a tree; a leaf's run is the
list of its different digests with the identifier to keep and the number of copies.  In
every round ``WAYS`` neighbouring nodes exchange their runs: they are dealt by node and
digest, sorted, and merged by a sorted aggregate, which retains one identifier for each
digest.  After some ``log(leaves)`` rounds one run is left, spread over all tasks by its
digests.  The answer goes back down the same way, from each node to the ``WAYS`` below
it and at last to the rows.

So no key of any round has more than ``WAYS`` rows of the round before, and the copies of
one text, however many, never meet in one task: they are one row per leaf from the first
round on, and each leaf's rows are as many as a partition had.  A text is read once and
never moves; digests are compared in full (SHA-256 and the number of bytes), which is
what verifies a match.  Every run is written to the shared folder, so a lost executor
costs part of one round.

Defined results: a null text counts as empty, and all empty texts are one group.  Rows
with the same text and the same identifier are told apart by the order in which they
were read: one of them stays.  A null identifier is kept only where a group has no other;
``keep_id`` is null then.  An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.llm.store import Scratch, only

WAYS_BITS = 4
WAYS = 1 << WAYS_BITS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGEST = ["digest", "size"]


def folded(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    # Where every character is one byte, both ways agree and the first is much faster.
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Each row's group of equal texts: the ``largest`` (or ``smallest``) identifier stays.

    Returns doc_id, keep_id, group_size, kept and text_sha256, a row per row of ``docs``.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    scratch = Scratch(docs.sparkSession, "copies")
    text = folded(F.col("text"))
    place = F.monotonically_increasing_id()
    rows = scratch.save(only(docs, doc_id="bigint", text="string").select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("size"), place.alias("place")), "rows")
    rows = rows.withColumn("node", F.shiftright("place", 33))
    # Larger is better in both members; the place makes the choice among equal identifiers.
    rank = F.col("doc_id") if keep == "largest" else -F.col("doc_id")
    best = F.struct(rank.alias("rank"), (-F.col("place")).alias("turn"))
    runs = [scratch.save(_merged(rows.withColumns({"best": best, "copies": F.lit(1).cast("bigint")}), F.col("node")), "run0")]
    last = rows.agg(F.max("node")).first()[0] or 0
    while last:
        runs.append(scratch.save(_merged(runs[-1], _above()), f"run{len(runs)}"))
        last >>= WAYS_BITS
    told = runs[-1]
    for run in reversed(runs[:-1]):
        told = _told(run.select("node", *_DIGEST), told, _above())
    found = _told(rows, told, F.col("node"))
    keep_id = F.col("best.rank") if keep == "largest" else -F.col("best.rank")
    return found.select(
        "doc_id", keep_id.alias("keep_id"), F.col("copies").alias("group_size"),
        (F.col("place") == -F.col("best.turn")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _above() -> Column:
    return F.shiftright("node", WAYS_BITS)


def _merged(runs: DataFrame, node: Column) -> DataFrame:
    """The runs of each ``node`` as one: a row per digest."""
    dealt = runs.withColumn("node", node)
    return dealt.groupBy("node", *_DIGEST).agg(F.max("best").alias("best"), F.sum("copies").alias("copies"))


def _told(run: DataFrame, above: DataFrame, node: Column) -> DataFrame:
    """``run`` with what the node above it says of each digest."""
    answer = above.select(F.col("node").alias("upper"), *_DIGEST, "best", "copies")
    return run.withColumn("upper", node).join(answer, ["upper", *_DIGEST]).drop("upper")
