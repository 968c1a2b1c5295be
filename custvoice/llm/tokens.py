"""Token ids of whole texts by the tokenizers library, with a memo of words.

The byte-level pre-tokenizer never joins a space to what stands before it, so a text
may be cut before every space between two characters that are no white space, and the
ids of the parts, put in a row, are the ids of the text.  Arrow cuts the texts of a batch
and finds the different parts.  A worker remembers the ids of parts (two generations, so
the memo stays bounded); parts not met before are encoded together, as one text, and told
apart by the number of bytes of their ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 900_000  # parts in a generation, some 100 MB
_LONG = 200  # characters; longer parts are rarely met twice
_ASKED = 200  # new parts encoded at a time
_SLICE = 1 << 22  # characters of texts worked on at a time
_GATHER = 1 << 20  # parts whose ids are put together at a time


def vocabulary() -> str:
    """The default vocabulary file, where the tokenizers package of this machine keeps it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"] or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cuts = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec["normalizer"] is None and not any(" " in t or not t for t in self.special)
        )
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2") if max(ids.values()) < 1 << 16 else np.dtype("<u4")
        self.size = np.zeros(max(ids.values()) + 1, np.int64)
        for token, i in ids.items():
            # One character of a byte-level token stands for one byte.
            self.size[i] = len(token.encode()) if token in self.special else len(token)
        self.young, self.old = _Memo(self.kind), _Memo(self.kind)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, parts: list[str]) -> None:
        """Put parts into the memo: those a text begins with have a mark, the others follow a space."""
        known = [part for part in parts if part in self.old.rows]
        rows = np.fromiter(map(self.old.rows.__getitem__, known), np.int64, len(known))
        lengths = self.old.lengths(rows)
        self.young.add(known, self.old.gather(rows, lengths), lengths)
        ask = []
        for part in parts:
            if part in self.old.rows:
                continue
            if part[:1] == _HEAD:
                ids = self._plain(part[1:])
                self.young.add([part], ids, np.array([len(ids)]))
            else:
                ask.append(part)
        for at in range(0, len(ask), _ASKED):
            some = ask[at : at + _ASKED]
            ids = self._plain(" " + " ".join(some))
            stops = np.cumsum(pc.binary_length(pa.array(some, pa.large_string())).to_numpy() + 1)
            ends = np.searchsorted(np.cumsum(self.size[ids]), stops) + 1
            self.young.add(some, ids, np.diff(ends, prepend=0))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of the whole text, as ``tokenizer.encode(text, add_special_tokens=False)`` gives them."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; what the memo lacks is asked for together."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        if not self.cuts:
            return [self._plain(text) for text in texts.to_pylist()]
        found: list[np.ndarray | None] = [None] * len(texts)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        row = 0
        while row < len(texts):
            start = int(sizes[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(sizes, start + _SLICE, "right")))
            some = texts.slice(row, stop - row)
            odd = pc.match_substring_regex(some, _ODD).to_numpy(zero_copy_only=False)
            for rows, cut in ((np.flatnonzero(~odd), _cut), (np.flatnonzero(odd), _cut_odd)):
                if len(rows):
                    for i, ids in zip(rows.tolist(), self._ids_of(cut(some.take(pa.array(rows))))):
                        found[row + i] = ids
            row = stop
        return found

    def _ids_of(self, parts: pa.LargeListArray) -> list[np.ndarray]:
        """The ids of the parts of each text, put in a row."""
        kinds = parts.flatten().dictionary_encode()
        index = kinds.indices.to_numpy()
        names = kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.young.rows
        lacking = [name for name in names if name not in known]
        self._learn(lacking)
        rows = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        lengths = self.young.lengths(rows)
        many = lengths[index]
        stops = np.cumsum(many)
        pieces = [self.young.gather(rows[some], lengths[some]) for some in (index[at : at + _GATHER] for at in range(0, len(index), _GATHER))]
        whole = np.concatenate(pieces) if pieces else np.zeros(0, self.kind)
        ends = np.append(0, stops)[parts.offsets.to_numpy()]
        for part in lacking:
            if len(part) > _LONG:
                del known[part]
        if len(known) > MEMO or self.young.used > 8 * MEMO:
            self.old, self.young = self.young, _Memo(self.kind)
        return [whole[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


class _Memo:
    """Parts and their ids, these one after the other in one array."""

    def __init__(self, kind: np.dtype):
        self.rows: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, kind), 0
        self.ends, self.count = np.zeros(1 << 14, np.int64), 1

    def add(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.count + len(parts) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[self.count : self.count + len(parts)] = self.used + np.cumsum(lengths)
        self.rows.update(zip(parts, range(self.count, self.count + len(parts))))
        self.used, self.count = self.used + len(ids), self.count + len(parts)

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows] - self.ends[rows - 1]

    def gather(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of the parts in these rows, in a row."""
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        shift = self.ends[rows - 1] - (stops - lengths)
        return self.ids[np.repeat(shift, lengths) + np.arange(total)]


def _cut(texts: pa.LargeStringArray) -> pa.LargeListArray:
    """Parts of texts in which every space stands between two characters that are no white space."""
    marked = pc.binary_join_element_wise(pa.scalar(_HEAD, pa.large_string()), texts, pa.scalar("", pa.large_string()))
    return _large(pc.split_pattern(marked, " "))


def _cut_odd(texts: pa.LargeStringArray) -> pa.LargeListArray:
    return _large(pa.array([_parts(text) if text else [] for text in texts.to_pylist()], pa.large_list(pa.large_string())))


def _large(lists: pa.Array) -> pa.LargeListArray:
    return lists.cast(pa.large_list(pa.large_string()))


def _parts(text: str) -> list[str]:
    """The text cut at each space that stands between two characters that are no white space.

    The first part bears a mark; to each other part the space before it belongs.
    """
    parts = text.split(" ")
    if any(map(text.__contains__, _PAIRS)) or not text.isascii() and any(map(text.__contains__, _WIDE)) or not (parts[0] and parts[-1]):
        joined = parts[:1]
        for part in parts[1:]:
            if part[:1].strip() and joined[-1][-1:].strip():
                joined.append(part)
            else:
                joined[-1] += " " + part
        parts = joined
    parts[0] = _HEAD + parts[0]
    return parts


_HEAD = "\n"  # no other part begins with it: white space after a space is never cut off
#: White space beside a space, and white space beyond ASCII (fixed by Unicode).
_PAIRS = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
#: Texts that ``_parts`` has to look at word by word: empty ones too, and those with a space at an end.
_ODD = "^$|^ | $|" + "|".join((*_PAIRS, *_WIDE))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
