"""A Merkle manifest of a dataset that stores only every few levels of its trees.

The rows of a tree in order are its leaves; every ``WIDTH`` consecutive nodes of a level
have one parent, the hash of their digests one after the other, until one node is left.
Only every ``STEP``-th level is written.  An aligned subtree, the up to ``WIDTH ** STEP``
stored nodes below one node of the next stored level, is the unit of work: ``grow``
collects each subtree's stored nodes and hashes them up to its top, and ``paths``, to
extract proofs, collects them again, regenerates the levels in between, emits the
siblings of every node on its way up, and forgets them.  Proofs run down the stored
levels: a subtree is joined with the path of its top, which all its nodes share.

A group never has more than ``WIDTH ** STEP`` rows, whatever the size of a tree, so a
source with most of the rows is spread over as many tasks as it has subtrees.  The place
of a row in its tree comes from a range partitioning and one count for each tree and
partition; only a scalar (the size of the largest tree) reaches the driver.  Stored
levels lie in the shared folder, so a lost executor costs single tasks.

Defined results: rows that share an identifier stand in the order of their digests; null
identifiers come first; equal rows are equal leaves, each with a place of its own.  A
lone leaf is its tree's root, with an empty path.  An empty table has no trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from custvoice.llm.copies import folded
from custvoice.llm.store import Scratch, only

WIDTH = 16
STEP = 2


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _parents(nodes: Column) -> Column:
    """The hashes of every ``WIDTH`` consecutive nodes of an array."""
    starts = F.sequence(F.lit(0), F.size(nodes) - 1, F.lit(WIDTH))
    return F.transform(starts, lambda i: digest(_joined(F.slice(nodes, i + 1, F.lit(WIDTH)))))


def _count(level: int) -> Column:
    """How many nodes a tree has so many levels above its ``n`` stored ones."""
    return F.expr(f"(n + {WIDTH**level - 1}) div {WIDTH**level}")


def placed(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``idx``, the place in the order of their ``tree``, and ``n``, the size of the tree."""
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    laid = scratch.save(laid, name).withColumn("part", F.shiftright("at", 33))
    own = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    tree = W.partitionBy("tree")
    before = F.sum("own").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = own.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(tree).alias("n"))
    return laid.join(starts, ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _subtrees(nodes: DataFrame, *payload: str) -> DataFrame:
    """One row for each aligned subtree of the trees that have more than one node: all its levels but the last, as arrays."""
    kid = F.struct("idx", "node", *payload)
    groups = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {WIDTH**STEP}").alias("gid")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
    groups = groups.withColumn("level0", F.transform("kids", lambda x: x["node"]))
    for k in range(1, STEP):
        below = F.col(f"level{k - 1}")
        groups = groups.withColumn(f"level{k}", F.when(_count(k - 1) > 1, _parents(below)).otherwise(below))
    return groups


@dataclass
class Trees:
    """The stored levels of one or more trees, each a table of tree, idx, n and node."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (x.where("n = 1").select("tree", "node") for x in self.levels))


def grow(leaves: DataFrame, scratch: Scratch, name: str) -> Trees:
    """The stored levels above ``leaves`` (tree, idx, n, node)."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        top = F.col(f"level{STEP - 1}")
        node = F.when(_count(STEP - 1) > 1, _parents(top)).otherwise(top)[0]
        above = _subtrees(levels[-1].select("tree", "idx", "n", "node")).select("tree", F.col("gid").alias("idx"), _count(STEP).alias("n"), node.alias("node"))
        levels.append(scratch.save(above, f"{name}{len(levels) * STEP}"))
        most = -(-most // WIDTH**STEP)
    return Trees(levels)


def _siblings(place: Column, level: int) -> Column:
    """What stands left and right of the ancestor ``level`` steps above a node, in its run; null beyond the root."""
    nodes = F.col(f"level{level}")
    at = F.floor(place / F.lit(WIDTH**level)).cast("int")
    start = at - at % WIDTH
    left = _joined(F.slice(nodes, start + 1, at - start))
    right = _joined(F.slice(nodes, at + 2, start + F.lit(WIDTH - 1) - at))
    return F.when(_count(level) > 1, F.struct(left.alias("left"), right.alias("right")))


def _own_path(place: Column) -> Column:
    return F.filter(F.array(*(_siblings(place, k) for k in range(STEP))), lambda x: x.isNotNull())


def paths(trees: Trees, tops: DataFrame, *payload: str) -> DataFrame:
    """A row for each leaf: tree, node, the ``payload`` columns of leaves, and ``path``.

    ``path`` lists, from the leaf to the top, the digests to the left and to the right,
    joined, of every node on the way.  ``tops`` has a row for each tree, with the path
    above its root and columns to hand down.
    """
    hand = [c for c in tops.columns if c not in ("tree", "path")]
    done = None
    for number in range(len(trees.levels) - 1, -1, -1):
        nodes = trees.levels[number]
        extra = payload if number == 0 else ()
        lone = nodes.where("n = 1").join(tops, "tree").select("tree", "idx", "node", *extra, "path", *hand)
        if done is not None:
            above = done.select("tree", F.col("idx").alias("gid"), "path", *hand)
            groups = _subtrees(nodes, *extra).join(above, ["tree", "gid"])
            each = F.transform("kids", lambda x, i: F.struct(x.alias("kid"), F.concat(_own_path(i), F.col("path")).alias("path")))
            inner = groups.select("tree", *hand, F.inline(each))
            below = inner.select("tree", "kid.idx", "kid.node", *(f"kid.{c}" for c in extra), "path", *hand)
            lone = lone.unionByName(below)
        done = lone
    return done.drop("idx")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["left"], node, x["right"]))


def flat(path: Column) -> Column:
    """All siblings of a path in order, left to right and level by level, as one string."""
    return _joined(F.transform(path, lambda x: F.concat(x["left"], x["right"])))


@dataclass
class Manifest:
    """A tree for each source, whose roots are the leaves of one more tree."""

    sources: Trees
    whole: Trees

    def proofs(self, *payload: str) -> DataFrame:
        """A row for each document: leaf, the ``payload`` columns, path, subroot and root."""
        empty = F.array().cast("array<struct<left:string,right:string>>")
        top = self.whole.roots.select("tree", empty.alias("path"), F.col("node").alias("root"))
        upper = paths(self.whole, top, "name").select(F.col("name").alias("tree"), "path", F.col("node").alias("subroot"), "root")
        return paths(self.sources, upper, *payload).withColumnRenamed("node", "leaf").drop("tree")


def build(leaves: DataFrame, scratch: Scratch) -> Manifest:
    """The manifest of ``leaves``: source, doc_id, leaf, and columns to be carried along."""
    # The order of names: null first, then by bytes.
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "source"))
    rows = leaves.withColumn("tree", name).drop("source").withColumnRenamed("leaf", "node")
    sources = grow(placed(rows, ["doc_id", "node"], scratch, "leaves"), scratch, "level")
    roots = sources.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    return Manifest(sources, grow(placed(roots, ["name"], scratch, "subroots"), scratch, "upper"))


def document_leaves(docs: DataFrame, suspect: Column | None = None) -> DataFrame:
    """source, doc_id and leaf of each document, and ``altered``: its leaf with the text's A-Z in lower case, where ``suspect``."""
    plain = only(docs, doc_id="bigint", source="string", lang="string", n_chars="bigint", text="string")
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*head, field(F.col("text")))
    lowered = F.when(F.col("text").isNotNull(), folded(F.col("text")))
    altered = F.when(F.lit(False) if suspect is None else suspect, digest(*head, field(lowered)))
    return plain.select("source", "doc_id", leaf.alias("leaf"), altered.alias("altered"))


def verify(docs: DataFrame, suspect: Column | None = None) -> DataFrame:
    """Every document's proof, and the root that its leaf (its altered leaf, where ``suspect``) leads to.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    leaves = scratch.save(document_leaves(docs, suspect), "digests")
    proofs = build(leaves, scratch).proofs("doc_id", "altered")
    folded_root = fold(F.coalesce("altered", "leaf"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(flat(F.col("path")), 256).alias("proof_sha256"),
                         folded_root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
