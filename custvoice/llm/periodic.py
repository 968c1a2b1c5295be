"""Runs of periodic words, found by seeds that are extended along diagonals.

A run with smallest period ``q`` matches itself ``q`` words on, over at least
``max(LEAST - q, q)`` words: that overlap guarantees a seed.  Lags are taken in classes:
seeds of ``LEAST // 2`` words serve all lags below eight, seeds of ``2 ** j`` words serve
lags from ``2 ** j`` up to, not including, ``2 ** (j + 1)``.  Of each class the k-grams
that stand more than once in a document are indexed, and two occurrences whose distance
lies in the class are a seed on the diagonal of that distance.

Occurrences closer together than half a seed make a periodic k-gram, of which a text can
hold very many pairs.  Of the last seed of a run's overlap, however, the two occurrences
cannot both have a next one so near: the run would go on.  So only pairs are taken in
which one of the two is the last of its cluster, and these are in proportion to the
words.  A table of the furthest word covered at each lag passes over seeds of a diagonal
that has been extended already; what is left is extended word by word in both directions.

Defined results: a null, empty or blank text has no words and no runs.  Words are
compared through 64-bit hashes.  Every row is a document of its own, whatever its
identifier; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from custvoice.llm.store import only
from custvoice.llm.words import Words, fresh, mix, runs

LEAST = 12
_SEED = LEAST // 2
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _repeated(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the k-grams that begin at the rising places ``at``, those that occur twice: in groups, places rising, and each one's group."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = fresh(ordered)
    many = ~(new & np.append(new[1:], True))
    return at[order[many]], np.cumsum(new[many])


def _pairs(at: np.ndarray, group: np.ndarray, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the same k-gram with a lag of ``low`` to ``high - 1``, one of them the last of its cluster."""
    n = len(at)
    gap = np.full(n, np.iinfo(np.int64).max)
    gap[:-1] = np.where(group[1:] == group[:-1], np.diff(at), gap[:-1])
    last = gap > k // 2
    cluster = np.cumsum(last) - last
    left, right = [], []
    key = group.astype(np.int64) * (int(at.max()) + 2 * high + 2) + at
    until = np.searchsorted(key, key + high)  # the first occurrence beyond the lag
    since = np.searchsorted(key, key - high, "right")
    lasts = np.flatnonzero(last)
    for begin, end in ((lasts + 1, until[lasts]), (since[lasts], lasts)):
        many = end - begin
        other = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        own = np.repeat(lasts, many)
        left.append(np.minimum(own, other))
        right.append(np.maximum(own, other))
    one, two = np.concatenate(left), np.concatenate(right)
    fits = at[two] - at[one] >= low
    if low > k // 2:
        fits &= cluster[one] != cluster[two]
    return at[one[fits]], at[two[fits]]


def seeds(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each class its seed length and the pairs of places; documents begin at the words ``first``."""
    n = len(words)
    doc = np.searchsorted(first, np.arange(n), "right")
    longest = int(np.diff(np.append(first, n)).max(initial=0))
    if longest < LEAST:
        return
    # Words are told apart by document, so no k-gram reaches over a border unnoticed or meets one of another document.
    own = mix(words ^ mix(doc.astype(np.uint64)))
    two = mix(own[:-1]) + own[1:]
    four = mix(two[:-2]) + two[2:]
    six = mix(four[:-2]) + two[4:]
    inside = np.flatnonzero(doc[: len(six)] == doc[_SEED - 1 :])
    at, group = _repeated(six[inside], inside)
    if not len(at):
        return
    yield _SEED, *_pairs(at, group, _SEED, 1, 8)
    # Longer seeds stand where their first six words are repeated.
    at = np.sort(at)
    at = at[at + 8 <= n]
    at = at[doc[at] == doc[at + 7]]
    gram, k = mix(four[at]) + four[at + 4], 8
    while len(at) and 2 * k <= longest:
        places, group = _repeated(gram, at)
        if not len(places):
            return
        yield k, *_pairs(places, group, k, k, 2 * k)
        # A seed of twice the length is two of this one, one behind the other.
        order = np.argsort(places)
        known = np.full(n + k, -1, np.int64)
        known[at] = np.arange(len(at))
        at_ = places[order]
        then = known[at_ + k]
        good = then >= 0
        at_, then = at_[good], then[good]
        gram, at, k = mix(gram[known[at_]]) + gram[then], at_, 2 * k


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The runs in the words (hashes) of documents that begin at ``first``: first word, the word after, period; by place.

    Places are those in ``words``; no run reaches over the border of a document.
    """
    n = len(words)
    ends = np.append(first[1:], n)
    found: dict[tuple[int, int], int] = {}
    for k, x, y in seeds(words, first):
        if not len(x):
            continue
        lag = y - x
        order = np.lexsort((x, lag))
        x, lag = x[order], lag[order]
        # A seed right behind another on its diagonal is covered by that one's extension.
        head = fresh(lag) | np.append(True, np.diff(x) != 1)
        covered: dict[int, int] = {}
        for i, q in zip(x[head].tolist(), lag[head].tolist()):
            if i + k <= covered.get(q, 0):
                continue
            d = int(np.searchsorted(first, i, "right")) - 1
            begin, end = _extend(words, int(first[d]), int(ends[d]), i, i + k, q)
            covered[q] = end
            length = end + q - begin
            if length >= max(LEAST, 2 * q):
                # Of the periods of one stretch the smallest counts.
                found[begin, end + q] = min(q, found.get((begin, end + q), q))
    return np.array(sorted((a, b, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


def _extend(words: np.ndarray, low: int, high: int, begin: int, end: int, q: int) -> tuple[int, int]:
    """The widest stretch around ``begin`` to ``end`` that equals what stands ``q`` words on, from ``low`` to ``high``."""
    step = 16
    while end + q < high:
        stop = min(end + step, high - q)
        differ = np.flatnonzero(words[end:stop] != words[end + q : stop + q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    step = 16
    while begin > low:
        start = max(begin - step, low)
        differ = np.flatnonzero(words[start:begin] != words[start + q : begin + q])
        if len(differ):
            begin = start + int(differ[-1]) + 1
            break
        begin, step = start, 2 * step
    return begin, end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for some, data, offsets in runs(batch):
            w = Words(data, offsets)
            first = np.asarray(w.first[:-1])
            full = np.flatnonzero(w.counts)  # documents without words have no place of their own
            found = find_runs(w.hashes(), first[full]) if len(w) else np.zeros((0, 3), np.int64)
            doc = full[np.searchsorted(first[full], found[:, 0], "right") - 1] if len(found) else np.zeros(0, np.int64)
            many = np.bincount(doc, minlength=len(first))
            members = [pa.array(found[:, 0] - first[doc]), pa.array(found[:, 1] - found[:, 0]), pa.array(np.ascontiguousarray(found[:, 2]))]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.StructArray.from_arrays(members, fields=list(kind)))
            # Each word that a run holds after its first period goes.
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 1], -1)
            kept = np.cumsum(edge[:-1]) == 0
            raw = data.tobytes()
            texts = []
            for d, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                words = raw[i:j].split()
                if many[d]:
                    stay = kept[first[d] : first[d] + len(words)]
                    words = [words[t] for t in np.flatnonzero(stay).tolist()]
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([some["doc_id"], lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, ``runs`` by start and period, and ``collapsed``: the words that no run repeats, joined by one space."""
    return only(docs, doc_id="bigint", text="string").mapInArrow(_scan, f"doc_id bigint, runs {RUN}, collapsed string")
