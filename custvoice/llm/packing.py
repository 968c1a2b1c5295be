"""Packing of token ids into windows by multiway differencing.

Each text becomes its ids and an end id.  Whole windows are cut off first; what is
left is cut into pieces of at most a quarter window and dealt, by a hash of where
the piece was written, into groups of about ``GROUP`` pieces.  In a group the
Karmarkar-Karp method starts with one partial partition for each piece and keeps
merging the two with the widest spread, the fullest window of one onto the emptiest
of the other, so imbalances cancel.  The window count starts at what the sum asks for
and rises whenever a window holds more than its capacity.

Defined results: a null or empty text is its end id alone; repeated rows are texts of
their own; a null id is carried as it is; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvoice.llm.store import Scratch, only
from custvoice.llm.tokens import encoder
from custvoice.llm.words import runs

WINDOW = 2048
GROUP = 1500
BATCH = 1 << 22  # bytes of texts encoded together

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, row bigint"


def _pieces(path: str, end_id: int, window: int) -> Callable:
    share = max(1, window // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            for some, _, _ in runs(batch, size=BATCH):
                rows = []
                for doc, ids in zip(some["doc_id"].to_pylist(), enc.encode_all(some["text"])):
                    whole = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                    full = len(whole) // window * window
                    cuts = [*range(0, full, window), *range(full, len(whole), share), len(whole)]
                    for a, b in zip(cuts, cuts[1:]):
                        rows.append((doc, a, b - a, zlib.crc32(whole[a:b].tobytes()), len(whole), part, row))
                        row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row"],
                )

    return run


def partition(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` near-equal parts, by multiway differencing.

    A partial partition lists the windows in use alone, by rising sums; the others are empty.
    """
    parts: list[tuple] = []  # heap of (-spread, tie, sums rising, node of each window)
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    for tie, i in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        parts.append((-int(sizes[i]), tie, sizes[i : i + 1].astype(np.int64), np.array([i])))
    heapq.heapify(parts)
    tie = len(parts)
    while len(parts) > 1:
        _, _, sums, nodes = heapq.heappop(parts)
        _, _, more, others = heapq.heappop(parts)
        # The largest of one meet the smallest of the other; where there are windows enough, none meets one in use.
        met = len(sums) + len(more) - windows
        if met > 0:
            numbers = np.arange(len(left), len(left) + met)
            left += nodes[:met].tolist()
            right += others[:met][::-1].tolist()
            both = sums[:met] + more[:met][::-1]
            sums, nodes = np.concatenate((both, sums[met:], more[met:])), np.concatenate((numbers, nodes[met:], others[met:]))
        else:
            sums, nodes = np.concatenate((sums, more)), np.concatenate((nodes, others))
        order = sums.argsort(kind="stable")
        sums, nodes = sums[order], nodes[order]
        if len(sums) == windows:
            sums = sums - sums[0]
        heapq.heappush(parts, (-int(sums[-1]), tie, sums, nodes))
        tie += 1
    found = []
    for node in parts[0][3].tolist() if parts else []:
        items, todo = [], [node]
        while todo:
            n = todo.pop()
            if left[n] < 0:
                items.append(n)
            else:
                todo += [left[n], right[n]]
        found.append(items)
    return found


def fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their count rises until none exceeds it."""
    if not len(sizes):
        return []
    windows = -(-int(sizes.sum()) // capacity)
    while True:
        found = [items for items in partition(sizes, windows) if items]
        if all(sizes[items].sum() <= capacity for items in found):
            return found
        windows += max(1, windows // 200)


def _pack(capacity: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row", "ascending")])
        sizes = table["length"].to_numpy()
        window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, items in enumerate(fit(sizes, capacity)):
            items = np.sort(items)
            window[items] = w
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        sequence = (table["bin"].to_numpy() << 32) + window
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row for each piece: where it comes from, and its place in which window.

    The pieces are written once, so a group that is packed again after a lost
    executor meets the same pieces.  Groups hold ``GROUP`` pieces or so, whatever the
    size of the table: their number grows with it.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    plain = only(docs, doc_id="bigint", text="string")
    pieces = scratch.save(plain.mapInArrow(_pieces(vocabulary, end_id, window), PIECE), "pieces")
    short = pieces.where(F.col("length") < window)
    groups = max(1, short.count() // GROUP)
    dealt = short.withColumn("bin", F.pmod(F.xxhash64("part", "row"), F.lit(groups)).cast("bigint"))
    packed = dealt.groupBy("bin").applyInArrow(_pack(window), f"{PIECE}, bin bigint, sequence_id bigint, offset bigint")
    whole = pieces.where(F.col("length") == window).select(
        "*", F.lit(0).cast("bigint").alias("bin"),
        (F.shiftleft(F.col("part") + groups, 32) + F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(whole).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
