"""Benchmark questions in documents, found by their templates.

Words are stripped of punctuation and lower-cased, and become template tokens: numbers
(number words too) one placeholder, units after a number another, names (capitals inside
a sentence) a third.  A capital word that begins a sentence or line may be a name or not:
windows are made both ways, with it as a name and as itself.  Windows of ``WINDOW`` template tokens of a document are joined by hash with
those of the benchmark.  A question is leaked where the joined windows cover a share
``COVER`` of it and the slots agree: what stands for one value of the question must be
one value in the document, so a question asked again with other numbers or names is
caught, and unrelated sentences of the same build are not.

The benchmark goes to the workers in blocks of at most ``BLOCK`` words, so what is sent
at once has a bound whatever its size; documents are read once for each block (one,
for any usual benchmark), and never shuffled.

Defined results: a null, empty or short text (fewer than ``WINDOW`` tokens) leaks
nothing; items of three tokens or fewer, and items of placeholders alone, say too little
and are left out, items shorter than a window are one window; repeated rows are tested each; empty tables find nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvoice.llm.store import only
from custvoice.llm.words import LOWER, Words, fresh, hash_spans, mix, runs

WINDOW = 6
SHORTEST = 4
COVER = 0.5
AGREE = 0.8  # share of slots that must keep to one value
BLOCK = 2_000_000

# Units of measure and money.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter "
    "centimeters centimetre centimetres millimeter millimeters millimetre millimetres mg g kg gram grams kilogram kilograms milligram milligrams "
    "ton tons tonne tonnes ounce ounces oz pound pounds lb lbs ml cl l liter liters litre litres milliliter milliliters millilitre millilitres "
    "gallon gallons acre acres hectare hectares second seconds s minute minutes min hour hours h day days week weeks month months year years percent degrees dollar dollars euro euros cent cents "
    "usd eur gbp w kw v volt volts watt watts joule joules newton newtons amp amps hz mph kmh bytes kb mb gb"
).split()

# Numbers as words.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_ENDER = np.zeros(256, bool)
_ENDER[list(b".!?:\n")] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,")] = True
_PLACEHOLDERS = mix(np.array([101, 102, 103], np.uint64))
_NUMBER, _UNIT, _NAME = _PLACEHOLDERS


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of A-Z and of capital letters of Latin-1 in UTF-8, and where such a capital ends."""
    folded = LOWER[data]
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded[wide] += 32
    return folded, wide


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.concatenate([hash_spans(np.frombuffer(u.encode(), np.uint8), np.array([0]), np.array([len(u)])) for u in words]))


_UNITS, _NUMBERS = _hashes(UNITS), _hashes(NUMBERS)


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass
class Templates:
    """Tokens of a run of texts: template, the same with names where sentences begin, value, text, and the word each one was."""

    token: np.ndarray
    loose: np.ndarray
    value: np.ndarray
    text: np.ndarray
    word: np.ndarray
    slot: np.ndarray

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` tokens inside one text, both ways where they differ, and where each starts."""
        plain, at = self._windows(n, self.token)
        changed = np.concatenate(([0], np.cumsum(self.token != self.loose)))
        loose, where = self._windows(n, self.loose)
        other = changed[where + n] > changed[where]
        return np.concatenate((plain, loose[other])), np.concatenate((at, where[other]))

    def _windows(self, n: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.token) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(m, n, np.uint64)
        said = np.zeros(m, bool)
        for k in range(n):
            total = mix(total) + token[k : k + m]
            said |= ~np.isin(token[k : k + m], _PLACEHOLDERS)
        at = np.flatnonzero((self.text[:m] == self.text[n - 1 :]) & said)
        return mix(total[at]), at


def canonical(data: np.ndarray, offsets: np.ndarray) -> Templates:
    w = Words(data, offsets)
    if not len(w):
        none = np.zeros(0, np.int64)
        return Templates(*[np.zeros(0, np.uint64)] * 3, none, none, np.zeros(0, bool))
    place = np.arange(len(data))
    solid = _ALNUM[data]
    following = np.minimum.accumulate(np.where(solid, place, len(data))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(solid, place, -1))
    begin, end = following[w.starts], preceding[w.ends - 1] + 1
    word = np.flatnonzero(begin < end)
    begin, end, text = begin[word], end[word], w.doc()[word]
    folded, wide = _folded(data)
    # A unit written to its number is a token of its own.
    cut = np.minimum.accumulate(np.where(_NUMERIC[data], len(data), place)[::-1])[::-1][begin]
    glued = np.flatnonzero(_DIGIT[data[begin]] & (cut < end))
    glued = glued[_among(_UNITS, hash_spans(folded, cut[glued], end[glued]))]
    last_digit = preceding[cut[glued] - 1] + 1
    begin = np.insert(begin, glued + 1, cut[glued])
    until = end[glued]
    end[glued] = last_digit
    end = np.insert(end, glued + 1, until)
    word, text = np.insert(word, glued + 1, word[glued]), np.insert(text, glued + 1, text[glued])
    value = hash_spans(folded, begin, end)

    def count(mask: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        total = np.concatenate(([0], np.cumsum(mask)))
        return lambda a, b: total[b] - total[a]

    small = np.zeros(len(data), bool)
    small[:] = _SMALL[data]
    small[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0xA0)
    number = _DIGIT[data[begin]] | _among(_NUMBERS, value)
    first = fresh(text)
    after_number = np.concatenate(([False], number[:-1])) & ~first
    unit = after_number & ~number & _among(_UNITS, value)
    last = np.concatenate(([0], end[:-1]))
    starts = first | (count(_ENDER[data])(np.minimum(last, begin), begin) > 0)
    upper = (data[begin] >= 65) & (data[begin] <= 90)
    upper |= wide[np.minimum(begin + 1, len(data) - 1)] & (data[begin] == 0xC3)
    name = upper & (count(small)(begin, end) > 0) & ~number & ~unit
    loose = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    token = np.where(name & starts, value, loose)
    # Names in a row are one: the first stands for all.
    one = ~(name & ~starts & np.concatenate(([False], name[:-1])))
    return Templates(token[one], loose[one], value[one], text[one], (word - w.first[text])[one], (number | unit | name)[one])


@dataclass
class Benchmark:
    """Windows of a block of items by hash, and the items' tokens."""

    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    sizes: list[int]  # lengths of windows in use
    ids: list[int | None]
    windows: np.ndarray  # windows of each item
    tokens: list[tuple[np.ndarray, np.ndarray, int]]  # values, slots and window length of each item

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Benchmark:
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        made = canonical(np.frombuffer(b"".join(raw), np.uint8), offsets)
        first = np.searchsorted(made.text, np.arange(len(ids) + 1))
        lengths = np.diff(first)
        size = np.minimum(lengths, WINDOW)
        keys, items, places = [], [], []
        windows = np.zeros(len(ids), np.int64)
        for n in sorted({int(x) for x in size if x >= SHORTEST}):
            found, at = made.windows(n)
            own = size[made.text[at]] == n
            keys.append(found[own])
            items.append(made.text[at][own])
            places.append(at[own] - first[made.text[at][own]])
            windows += np.bincount(made.text[np.unique(at[own])], minlength=len(ids))
        if not keys:
            keys, items, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        key, item, where = map(np.concatenate, (keys, items, places))
        order = np.argsort(key, kind="stable")
        tokens = [(made.value[a:b], made.slot[a:b], int(n)) for a, b, n in zip(first, first[1:], size)]
        return cls(key[order], item[order], where[order], sorted({int(x) for x in size if x >= SHORTEST}), ids, windows, tokens)

    def leaks(self, made: Templates) -> list[tuple[int, int, float, int, int, int, int]]:
        """For texts of a run: text, item, share covered, first and last word, slots, slots of another value."""
        found_at, found_item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.sizes:
            found, at = made.windows(n)
            low = np.searchsorted(self.keys, found)
            hit = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == found) if len(self.keys) else np.zeros(0, np.int64)
            many = np.searchsorted(self.keys, found[hit], "right") - low[hit]
            found_at.append(np.repeat(at[hit], many))
            found_item.append(np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many))
        at, entry = np.concatenate(found_at), np.concatenate(found_item)
        text, item, place = made.text[at], self.items[entry], self.places[entry]
        order = np.lexsort((at, place, item, text))
        at, text, item, place = (x[order] for x in (at, text, item, place))
        pair = fresh(text) | fresh(item) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(pair)
        covered = np.add.reduceat(pair | fresh(place), begin) if len(at) else begin
        out = []
        for a, b, n_covered in zip(begin.tolist(), np.append(begin[1:], len(at)).tolist(), covered.tolist()):
            text_, item_ = int(text[a]), int(item[a])
            share = n_covered / int(self.windows[item_])
            if share >= COVER:
                row = self._judged(made, item_, list(zip(at[a:b].tolist(), place[a:b].tolist())))
                if row:
                    out.append((text_, item_, share, *row))
        return out

    def _judged(self, made: Templates, item: int, places: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
        """First and last word, slots, and slots of another value, of the windows at these places, if the slots agree."""
        values, slots, n = self.tokens[item]
        pairs = {(p + k, q + k) for p, q in places for k in range(n) if slots[q + k]}
        told: dict[int, Counter] = defaultdict(Counter)
        for p, q in pairs:
            told[int(values[q])][int(made.value[p])] += 1
        kept = sum(max(c.values()) for c in told.values())
        if kept < AGREE * len(pairs) and len(told) < len(pairs):
            # Several copies with different values may stand in one text: each is tested alone.
            by_shift: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for p, q in places:
                by_shift[p - q].append((p, q))
            if not any(self._agrees(made, item, some) for some in by_shift.values()):
                return None
        other = sum(int(made.value[p]) != int(values[q]) for p, q in pairs)
        return int(made.word[min(p for p, _ in places)]), int(made.word[max(p for p, _ in places) + n - 1]), len(pairs), other

    def _agrees(self, made: Templates, item: int, places: list[tuple[int, int]]) -> bool:
        values, slots, n = self.tokens[item]
        if len({q for _, q in places}) < COVER * int(self.windows[item]):
            return False
        told: dict[int, Counter] = defaultdict(Counter)
        pairs = {(p + k, q + k) for p, q in places for k in range(n) if slots[q + k]}
        for p, q in pairs:
            told[int(values[q])][int(made.value[p])] += 1
        return sum(max(c.values()) for c in told.values()) >= AGREE * len(pairs)


LEAK = "doc_id bigint, item_id bigint, covered double, start_word bigint, end_word bigint, n_slots bigint, n_changed bigint"


def _find(benchmark: Callable[[], Benchmark]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = benchmark()
        for batch in batches:
            for some, data, offsets in runs(batch):
                rows = items.leaks(canonical(data, offsets))
                docs = some["doc_id"].to_pylist()
                rows = [(docs[t], items.ids[i], c, a, b + 1, s, o) for t, i, c, a, b, s, o in rows]
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=["doc_id", "item_id", "covered", "start_word", "end_word", "n_slots", "n_changed"])

    return run


def _blocks(benchmark: DataFrame) -> list[Callable[[], Benchmark]]:
    spark = benchmark.sparkSession
    items = only(benchmark, item_id="bigint", text="string")
    words = items.agg(F.sum(F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+")))).first()[0] or 0
    blocks = 1 + words // BLOCK
    out = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(Benchmark.of(part["item_id"].to_pylist(), part["text"].to_pylist()))
        out.append(lambda sent=sent: sent.value)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it leaks: share covered, words from and to, slots, slots changed."""
    plain = only(docs, doc_id="bigint", text="string")
    parts = [plain.mapInArrow(_find(block), LEAK) for block in _blocks(benchmark)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; each row is judged by itself, in one pass."""

    def kept(block: Callable[[], Benchmark]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block()
            for batch in batches:
                for some, data, offsets in runs(batch):
                    found = {row[0] for row in items.leaks(canonical(data, offsets))}
                    yield some.filter(pa.array([i not in found for i in range(some.num_rows)]))

        return run

    for block in _blocks(benchmark):
        docs = docs.mapInArrow(kept(block), docs.schema)
    return docs
