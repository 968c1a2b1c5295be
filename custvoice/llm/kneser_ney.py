"""An interpolated modified Kneser-Ney model, counted in Spark and mapped by workers.

Counting.  Tasks count in sorted numpy arrays and send one array for each bucket of
hashes, so a frequent word travels once for each task and no bucket holds more than
its share of distinct hashes.  Merged buckets are written as files of sorted hash
arrays in the shared folder:

    words:   hash, count, how many words follow it once, twice, more often, how many precede it
    bigrams: hash of the pair of word numbers, count (a byte; larger ones listed apart)

A word's number is its rank among all word hashes.  Pairs are hashed one to one, so a
merged bucket gives back the two words of each pair; pairs whose first word is frequent
are spread over all buckets by the second.

Scoring.  Workers map the files and look words and pairs up by binary search, the
queries sorted so that neighbours share pages:

    p(w | v) = (c(vw) - D) / c(v) + g(v) * p(w)
    p(w)     = (n(w) - D') / n + g' / (V + 1)

where n(w) counts the words w follows, D the discounts by count 1, 2, 3 and more
estimated from counts of counts, and g what they set free.  A word never met has the
share ``g' / (V + 1)``; after one never met, ``p(w)`` alone counts.

Defined results: a null or empty text is its end alone; repeated rows are counted and
scored each; without any training text all probabilities are one, as only the unknown
word is left; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.llm.eliasfano import _system as file_system
from custvoice.llm.store import Scratch, only
from custvoice.llm.words import LOWER, Words, counted, mix, runs

END = np.uint64(0x454E44)  # the hash of the end of a text
HELD = 1_000_000  # hashes a task holds before it merges them
FINER = 3  # pairs have two to this power as many buckets as words: a bucket is merged in one worker's memory
MANY = 255


def unmix(x: np.ndarray) -> np.ndarray:
    """The integers that ``mix`` scrambles to these."""
    x = _unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = _unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return _unshift(x, 30) - np.uint64(0x9E3779B97F4A7C15)


def _unshift(x: np.ndarray, n: int) -> np.ndarray:
    out = x
    for _ in range(64 // n):
        out = x ^ (out >> np.uint64(n))
    return out


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts[order], begin) if len(keys) else counts


class _Tally:
    """Counts of hashes in bounded memory, or as many as are distinct."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = counted(keys)
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > HELD:
            self.settle()

    def settle(self) -> None:
        self.keys, self.counts = merged(np.concatenate([self.keys, *(k for k, _ in self.parts)]),
                                        np.concatenate([self.counts, *(c for _, c in self.parts)]))
        self.parts, self.held = [], 0


def _pack(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Keys, a byte for each count, and where counts are larger, place and count."""
    large = np.flatnonzero(counts >= MANY)
    return [keys.astype("<u8").tobytes(), np.minimum(counts, MANY).astype(np.uint8).tobytes(),
            large.astype("<u4").tobytes() + counts[large].astype("<u8").tobytes()]


def _unpack(keys: bytes, small: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    n = len(large) // 12
    counts[np.frombuffer(large, "<u4", n)] = np.frombuffer(large, "<u8", n, 4 * n)
    return np.frombuffer(keys, "<u8").astype(np.uint64), counts


def _store(folder: str, name: str, arrays: list[np.ndarray]) -> str:
    """Write arrays one after the other, each at a multiple of eight bytes; a fresh name for each attempt."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}.bin"
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        for array in arrays:
            raw = array.tobytes()
            out.write(raw + b"\0" * (-len(raw) % 8))
    return path


def _load(path: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file, mapped where the shared folder is a mounted one."""
    system, place = file_system(path)
    if system.type_name == "local":
        data = pa.memory_map(place).read_buffer()
    else:
        with system.open_input_file(place) as file:
            data = file.read_buffer()
    out, at = [], 0
    for kind, n in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += -(-n * np.dtype(kind).itemsize // 8) * 8
    return out


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


BLOBS = "bucket bigint, keys binary, small binary, large binary"


def _emit(tally: _Tally, bits: int, bucket: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    tally.settle()
    where = bucket(tally.keys) if bucket else _bucket(tally.keys, bits)
    order = np.argsort(where, kind="stable")
    stops = np.searchsorted(where[order], np.arange((1 << bits) + 1))
    for b, (i, j) in enumerate(zip(stops, stops[1:])):
        if j > i:
            own = order[i:j]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int64()), *(pa.array([x], pa.binary()) for x in _pack(tally.keys[own], tally.counts[own]))],
                names=["bucket", "keys", "small", "large"])


def _join(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(*row) for row in zip(*(table[c].to_pylist() for c in ("keys", "small", "large")))]
    return merged(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _count_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, ends = _Tally(), 0
        for batch in batches:
            for _, data, offsets in runs(batch):
                tally.add(Words(data, offsets).hashes(LOWER))
                ends += len(offsets) - 1
        if ends:
            tally.parts.append((np.array([END]), np.array([ends])))
            yield from _emit(tally, bits)

    return run


def _write_words(folder: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _join(table)
        b = table["bucket"][0].as_py()
        path = _store(folder, f"vocabulary-{b:06d}", [keys, counts])
        return pa.table({"bucket": [b], "file": [path], "distinct": [len(keys)], "total": [int(counts.sum())]})

    return run


class Vocabulary:
    """Numbers of words: ranks of their hashes over all files."""

    def __init__(self, files: list[tuple[int, str, int]], bits: int):
        self.bits = bits
        sizes = np.zeros(1 << bits, np.int64)
        for b, _, n in files:
            sizes[b] = n
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.size = int(self.base[-1])
        self.parts = {b: _load(path, [("<u8", n), ("<i8", n)]) for b, path, n in files}
        total = sum(int(counts.sum()) for _, counts in self.parts.values())
        often = [self.base[b] + np.flatnonzero(counts > total >> (bits + FINER + 2)) for b, (_, counts) in self.parts.items()]
        self.hot = np.concatenate(often) if often else np.zeros(0, np.int64)
        self.end = int(self.numbers(np.array([END]))[0])
        self.start = self.size + 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, ``size`` for one that is not there."""
        asked, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(asked), self.size, np.int64)
        stops = np.searchsorted(_bucket(asked, self.bits), np.arange((1 << self.bits) + 1))
        for b, (keys, _) in self.parts.items():
            i, j = stops[b], stops[b + 1]
            if j > i:
                at = np.minimum(np.searchsorted(keys, asked[i:j]), len(keys) - 1)
                out[i:j] = np.where(keys[at] == asked[i:j], self.base[b] + at, self.size)
        return out[back]


@lru_cache(maxsize=1)
def _vocabulary(files: tuple, bits: int) -> Vocabulary:
    return Vocabulary(list(files), bits)


def _sequence(w: Words, number: Callable[[np.ndarray], np.ndarray], end: int, start: int) -> np.ndarray:
    """For each text: a start, the numbers of its words, an end."""
    out = np.full(len(w) + 2 * len(w.counts), start, np.int64)
    if len(w):
        out[np.arange(len(w)) + 2 * w.doc() + 1] = number(w.hashes(LOWER))
    out[np.cumsum(w.counts + 2) - 1] = end
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash of a pair of word numbers, one to one."""
    return mix((v.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))


def pair_words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = unmix(keys)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pair_bucket(v: np.ndarray, w: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """All pairs with one first word in one bucket, but those of frequent first words in all buckets."""
    return _bucket(mix(np.where(np.isin(v, hot), w, v).astype(np.uint64)), bits)


def _count_pairs(files: tuple, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tally, any_ = _vocabulary(files, bits), _Tally(), False
        for batch in batches:
            for _, data, offsets in runs(batch):
                any_ = True
                row = _sequence(Words(data, offsets), words.numbers, words.end, words.start)
                inner = row[1:] != words.start
                tally.add(pair_key(row[:-1][inner], row[1:][inner]))
        if any_:
            yield from _emit(tally, bits + FINER, lambda keys: pair_bucket(*pair_words(keys), words.hot, bits + FINER))

    return run


STATS = "bucket bigint, kind string, a binary, b binary, file string, n bigint"


def _row(bucket: int, kind: str, a: bytes = b"", b: bytes = b"", file: str = "", n: int = 0) -> dict:
    return {"bucket": bucket, "kind": kind, "a": a, "b": b, "file": file, "n": n}


_STATS = pa.schema([("bucket", pa.int64()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("file", pa.string()), ("n", pa.int64())])


def _write_pairs(files: tuple, bits: int, folder: str) -> Callable:
    """A merged bucket of pairs becomes a file, and statistics of its words for the buckets of words."""

    def run(table: pa.Table) -> pa.Table:
        words = _vocabulary(files, bits)
        keys, counts = _join(table)
        b = table["bucket"][0].as_py()
        small, large = np.minimum(counts, MANY).astype(np.uint8), np.flatnonzero(counts >= MANY)
        path = _store(folder, f"pairs-{b:06d}", [keys, large.astype("<i8"), counts[large].astype("<i8"), small])
        v, w = pair_words(keys)
        own, back = np.unique(v, return_inverse=True)
        ones, twos = np.bincount(back, counts == 1).astype(np.int64), np.bincount(back, counts == 2).astype(np.int64)
        many = np.bincount(back, counts > 2).astype(np.int64)
        after, before = np.unique(w, return_counts=True)
        first = own == words.start
        sums = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int(x[first].sum()) for x in (ones, twos, many)]
        rows = [_row(-1 - b, "pairs", np.array(sums, "<i8").tobytes(), b"", path, len(keys) << 32 | len(large))]
        where = np.searchsorted(words.base, own, "right") - 1
        where_after = np.searchsorted(words.base, after, "right") - 1
        for k in words.parts:
            i, j = (where == k) & ~first, where_after == k
            if i.any() or j.any():
                follow = np.stack([own[i] - words.base[k], ones[i], twos[i], many[i]]).astype("<u4")
                rows.append(_row(k, "stats", follow.tobytes(), np.stack([after[j] - words.base[k], before[j]]).astype("<u4").tobytes()))
        return pa.Table.from_pylist(rows, _STATS)

    return run


def _write_numbers(files: tuple, bits: int, folder: str) -> Callable:
    """The statistics of a bucket of words, summed, in one file with their hashes and counts."""
    paths = {b: (path, n) for b, path, n in files}

    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        if b < 0:
            return table.cast(_STATS)
        path, n = paths[b]
        keys, counts = _load(path, [("<u8", n), ("<i8", n)])
        follow, before = np.zeros((3, n), np.int64), np.zeros(n, np.int64)
        for a, c in zip(table["a"].to_pylist(), table["b"].to_pylist()):
            a = np.frombuffer(a, "<u4").reshape(4, -1).astype(np.int64)
            for k in range(3):
                follow[k][a[0]] += a[k + 1]
            c = np.frombuffer(c, "<u4").reshape(2, -1).astype(np.int64)
            before[c[0]] += c[1]
        out = _store(folder, f"words-{b:06d}", [keys, counts, *(x.astype("<u4") for x in (*follow, before))])
        sums = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int(before.sum()), int((before > 2).sum())]
        return pa.Table.from_pylist([_row(b, "words", np.array(sums, "<i8").tobytes(), b"", out, n)], _STATS)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and three or more; fixed shares where too few counts tell."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


class Model:
    """The mapped files, ready to score."""

    def __init__(self, rows: tuple, bits: int):
        words = [r for r in rows if r[1] == "words"]
        self.vocabulary = Vocabulary([(b, path, n) for b, _, _, path, n in words], bits)
        self.words = {b: _load(path, [("<u8", n), ("<i8", n), ("<u4", n), ("<u4", n), ("<u4", n), ("<u4", n)]) for b, _, _, path, n in words}
        self.pairs = {}
        self.bits = bits
        high, low, start = np.zeros(4, np.int64), np.zeros(6, np.int64), np.zeros(3, np.int64)
        for b, kind, sums, path, n in rows:
            sums = np.frombuffer(sums, "<i8")
            if kind == "pairs":
                size, large = n >> 32, n & 0xFFFFFFFF
                self.pairs[-1 - b] = _load(path, [("<u8", size), ("<i8", large), ("<i8", large), ("u1", size)])
                high += sums[:4]
                start += sums[4:]
            else:
                low += sums
        self.v = self.vocabulary.size
        self.total = int(sum(int(x[1].sum()) for x in self.words.values()))
        self.discount = np.array((0.0, *discounts(*high.tolist())))
        self.low_discount = np.array((0.0, *discounts(*low[:4].tolist())))
        self.low_total = int(low[4])
        freed = float(self.low_discount[1:] @ np.array([low[0], low[1], low[5]]))
        self.unknown = freed / self.low_total / (self.v + 1) if self.low_total else 1.0
        self.start_follow = start
        self.end_count = self._facts(np.array([END]))[1][0] if self.v else 0

    def _facts(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of distinct rising hashes: number, count, words that follow once, twice, more often, words before."""
        number = np.full(len(hashes), self.v, np.int64)
        facts = np.zeros((5, len(hashes)), np.int64)
        stops = np.searchsorted(_bucket(hashes, self.bits), np.arange((1 << self.bits) + 1))
        for b, columns in self.words.items():
            i, j = stops[b], stops[b + 1]
            if j > i:
                at = np.minimum(np.searchsorted(columns[0], hashes[i:j]), len(columns[0]) - 1)
                hit = columns[0][at] == hashes[i:j]
                number[i:j] = np.where(hit, self.vocabulary.base[b] + at, self.v)
                for k in range(5):
                    facts[k, i:j] = np.where(hit, columns[k + 1][at], 0)
        return number, *facts

    def _pair_counts(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        known = np.flatnonzero((v != self.v) & (w != self.v))
        out = np.zeros(len(v), np.int64)
        keys, first, back = np.unique(pair_key(v[known], w[known]), return_index=True, return_inverse=True)
        bits = self.bits + FINER
        where = pair_bucket(v[known][first], w[known][first], self.vocabulary.hot, bits)
        order = np.argsort(where, kind="stable")
        stops = np.searchsorted(where[order], np.arange((1 << bits) + 1))
        counts = np.zeros(len(keys), np.int64)
        for b, (have, large, many, small) in self.pairs.items():
            own = order[stops[b] : stops[b + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                found = np.where(have[at] == keys[own], small[at].astype(np.int64), 0)
                big = np.flatnonzero(found == MANY)
                found[big] = many[np.searchsorted(large, at[big])] if len(big) else 0
                counts[own] = found
        out[known] = counts[back]
        return out

    def score(self, w: Words) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score (both log10)."""
        n = w.counts + 1
        if not self.total:
            zero = np.zeros(len(n))
            return n, zero.astype(np.int64), zero, zero
        asked, back = np.unique(np.append(w.hashes(LOWER), END), return_inverse=True)
        number, count, f1, f2, f3, before = self._facts(asked)
        low = self.low_discount[np.minimum(before, 3)]
        alone = np.maximum(before - low, 0) / self.low_total + self.unknown
        freed = np.where(count > 0, (f1 * self.discount[1] + f2 * self.discount[2] + f3 * self.discount[3]) / np.maximum(count, 1), 1.0)
        # A row of tokens with a start before each text; a start's facts stand at the end of each list.
        line = np.full(len(w) + 2 * len(n), len(asked))
        line[np.arange(len(w)) + 2 * w.doc() + 1] = back[:-1]
        line[np.cumsum(n + 1) - 1] = back[-1]
        texts = max(int(self.end_count), 1)
        number, count = np.append(number, self.vocabulary.start), np.append(count, texts)
        freed = np.append(freed, float(self.start_follow @ self.discount[1:]) / texts)
        alone = np.append(alone, 1.0)
        inner = np.flatnonzero(line[1:] != len(asked)) + 1
        v, u = line[inner - 1], line[inner]
        seen = self._pair_counts(number[v], number[u])
        share = np.maximum(seen - self.discount[np.minimum(seen, 3)], 0) / np.maximum(count[v], 1)
        logs = np.log10(share + freed[v] * alone[u])
        base = np.log10((count[u] + 1) / (self.total + self.v + 1))
        at = np.cumsum(n) - n
        return n, np.add.reduceat((count[u] > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)


@lru_cache(maxsize=1)
def _model(rows: tuple, bits: int) -> Model:
    return Model(rows, bits)


def train(docs: DataFrame) -> tuple[tuple, int]:
    """Count all texts of ``docs``; what comes back names the files, a row for each."""
    texts = only(docs, text="string")
    scratch = Scratch(docs.sparkSession, "language-model")
    folder = scratch.folder("files")
    # Buckets grow with the input: one for every four of its partitions, and for pairs two for each.
    bits = min(max(texts.rdd.getNumPartitions() // 4, 4).bit_length(), 16)
    blobs = texts.mapInArrow(_count_words(bits), BLOBS)
    manifest = blobs.groupBy("bucket").applyInArrow(_write_words(folder), "bucket bigint, file string, distinct bigint, total bigint").collect()
    files = tuple(sorted((r["bucket"], r["file"], r["distinct"]) for r in manifest))
    pairs = texts.mapInArrow(_count_pairs(files, bits), BLOBS).groupBy("bucket").applyInArrow(_write_pairs(files, bits, folder), STATS)
    rows = pairs.groupBy("bucket").applyInArrow(_write_numbers(files, bits, folder), STATS).collect()
    return tuple(sorted((r["bucket"], r["kind"], bytes(r["a"]), r["file"], r["n"]) for r in rows)), bits


def score(docs: DataFrame, model: tuple[tuple, int]) -> DataFrame:
    """Every row's tokens, known tokens, the model's training tokens, base score and score."""
    rows, bits = model
    shared = docs.sparkSession.sparkContext.broadcast(rows)  # names of files and a few sums for each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value, bits)
        for batch in batches:
            for part, data, offsets in runs(batch):
                n, known, base, logs = model.score(Words(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(logs)],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: the checksum of its id leaves 2 by 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))
