"""Words and shingles of many texts at once, in numpy over Arrow's own buffers.

A batch is cut into runs of rows of about ``CHUNK`` bytes, so the arrays made here
stay small whatever the size of Arrow batches; a single longer text is a run of its
own.  Hashes are 64 bits wide: two different shingles of a whole corpus of a billion
of them meet with a chance of a few in a hundred.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that part words: the space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower case of A-Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit integers, one to one."""
    x = (x + _GOLD).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 256), _GOLD, np.uint64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
    return _powers


class Words:
    """The words of a run of texts: bytes ``starts`` to ``ends`` of ``data``.

    ``first[d]`` to ``first[d + 1]`` are the words of text ``d``; ``offsets`` are the
    bytes of the texts.  A null text has no words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        inside = ~parts[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """A hash of every word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        value = (_BYTE if fold is None else _BYTE[fold])[self.data[self.inside]]
        value *= _power(int(lengths.max()))[np.arange(len(value)) - np.repeat(at, lengths)]
        return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))

    def shingles(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one text, and the word each starts at."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(hashes) - n + 1
        total = hashes[:m].copy()
        for k in range(1, n):
            total = mix(total) + hashes[k : k + m]
        at = np.arange(m)
        doc = self.doc()
        same = doc[:m] == doc[n - 1 :]
        return mix(total[same]), at[same]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; spans must not be empty and must not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    inner = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    value = _BYTE[data[inner + np.repeat(starts, lengths)]] * _power(int(lengths.max()))[inner]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))


def runs(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in runs of rows, with the bytes of ``column`` and their offsets."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = (texts if texts.null_count == 0 else texts.fill_null("")).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        stop = min(stop, len(texts))
        yield batch.slice(row, stop - row), whole[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of ``values`` over consecutive groups of ``counts`` items."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, rising."""
    values = np.sort(values)
    return values[fresh(values)]


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, rising, and how often each occurs."""
    values = np.sort(values)
    begin = np.flatnonzero(fresh(values))
    return values[begin], np.diff(np.append(begin, len(values)))


def fresh(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out
