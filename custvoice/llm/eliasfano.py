"""Token ids of a corpus in binary files with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents as one little-endian array (two bytes
an id where the vocabulary allows, else four).  Its boundaries, and its document ids,
rise, so each list is stored in the Elias-Fano way: of every value the low bits are
packed side by side, the high bits are a bit vector with one 1 for each value, and
positions of every ``SAMPLE``-th 1 let ``select`` start close to its goal.  That is
about ``2 + log2(universe / count)`` bits a document.

    bytes 0-7 magic, 8-15 documents, 16-23 documents without id, 24-31 smallest id (signed),
    32-39 ids, 40-47 bytes an id, then: list of boundaries, list of document ids, array of ids
    list: count, universe, low bits, bytes of low, high and samples (six 64-bit numbers), then these

Files are named after the attempt of the task that wrote them and counted only when
a finished task has named them, so a lost executor or a second attempt does no harm.

Defined results: a null or empty text is its end id alone; rows without id come first;
rows with one id stand in the order of a hash of their text; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvoice.llm.store import Scratch, only
from custvoice.llm.tokens import encoder
from custvoice.llm.words import runs

MAGIC = b"EFIDS001"
SAMPLE = 256
SHARD = 32_000_000  # ids in a file, about; a longer document is not cut
BATCH = 1 << 22  # bytes of texts encoded together
READ = 10_000  # documents looked up together


class EliasFano:
    """A rising list of numbers from 0 on, in near-minimal space."""

    def __init__(self, count: int, universe: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.count, self.universe, self.width = count, universe, width
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        count, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (universe // max(1, count)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1) if width else np.zeros((count, 0))
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(count)
        marks = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        marks[ones] = 1
        return cls(count, universe, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(marks, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        body = (self.low.tobytes(), self.high.tobytes(), self.samples.tobytes())
        return struct.pack("<6Q", self.count, self.universe, self.width, *map(len, body)) + b"".join(body)

    @classmethod
    def from_buffer(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        count, universe, width, *sizes = struct.unpack_from("<6Q", data, at)
        at += 48
        parts = []
        for size in sizes:
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(count, universe, width, parts[0], parts[1], np.frombuffer(parts[2].tobytes(), "<u4")), at

    def select(self, i: int) -> int:
        """The ``i``-th value: from the sample before it, over at most ``SAMPLE`` ones."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        bit, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            from_byte = (bit + 1) // 8
            window = np.unpackbits(self.high[from_byte : from_byte + 64], bitorder="little")
            ones = np.flatnonzero(window[bit + 1 - 8 * from_byte :]) + bit + 1
            if len(ones) >= left:
                bit, left = int(ones[left - 1]), 0
            else:
                left -= len(ones)
                bit = 8 * (from_byte + 64) - 1
        low = 0
        for k in range(self.width):
            p = i * self.width + k
            low |= (int(self.low[p >> 3]) >> (p & 7) & 1) << k
        return (bit - i << self.width) | low

    def select_many(self, i: int, j: int) -> np.ndarray:
        """The ``i``-th to the ``j``-th value, without this last: one look at the stretch of bits between their samples."""
        if not 0 <= i <= j <= self.count:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        block, beyond = i // SAMPLE, (j - 1) // SAMPLE + 1
        first = int(self.samples[block])
        stop = int(self.samples[beyond]) if beyond < len(self.samples) else 8 * len(self.high)
        window = np.unpackbits(self.high[first // 8 : -(-stop // 8)], bitorder="little")
        ones = np.flatnonzero(window[first % 8 :])[i - block * SAMPLE : j - block * SAMPLE] + first
        found = (ones - np.arange(i, j)) << self.width
        if self.width:
            from_byte = i * self.width // 8
            bits = np.unpackbits(self.low[from_byte : -(-j * self.width // 8)], bitorder="little")
            bits = bits[i * self.width - 8 * from_byte :][: (j - i) * self.width].reshape(j - i, self.width)
            found |= (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)
        return found

    def values(self) -> np.ndarray:
        """All values at once, for tests."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        found = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.width].reshape(self.count, self.width)
            found |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return found.astype(np.int64)


class Shard:
    """A file of ids, read in place."""

    def __init__(self, data: memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        self.count, self.without, self.base, self.n_ids, self.width = struct.unpack_from("<QQqQQ", data, 8)
        self.bounds, at = EliasFano.from_buffer(data, 48)
        self.names, at = EliasFano.from_buffer(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """The identifiers of the ``i``-th to the ``j``-th document, without this last; those that have none come first."""
        nulls = min(max(self.without - i, 0), j - i)
        known = self.names.select_many(i + nulls - self.without, j - self.without) if j > self.without else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known + self.base, pa.int64())])

    def document(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document, found by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def shard_bytes(doc_ids: list[int | None], parts: list[np.ndarray]) -> list[bytes]:
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    kind = parts[0].dtype
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    header = MAGIC + struct.pack("<QQqQQ", len(parts), len(doc_ids) - len(known), base, int(bounds[-1]), kind.itemsize)
    names = np.array([d - base for d in known], np.uint64)
    return [header, EliasFano.of(bounds).to_bytes(), EliasFano.of(names).to_bytes(), *(p.tobytes() for p in parts)]


def open_shard(path: str) -> Shard:
    system, place = _system(path)
    if isinstance(system, pafs.LocalFileSystem):
        return Shard(memoryview(pa.memory_map(place).read_buffer()))
    with system.open_input_file(place) as file:
        return Shard(memoryview(file.read_buffer()))


def _write(folder: str, vocabulary: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        kind = enc.kind if end_id < 1 << 8 * enc.kind.itemsize else np.dtype("<u4")
        end = np.array([end_id], kind)
        system, place = _system(folder)
        system.create_dir(place, recursive=True)
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            file = f"ids-{part:06d}-{number:04d}-{uuid.uuid4().hex}.bin"
            with system.open_output_stream(f"{place}/{file}") as out:
                for piece in shard_bytes(names, parts):
                    out.write(piece)
            row = pa.RecordBatch.from_pylist([{"part": part, "number": number, "file": f"{folder}/{file}", "n_docs": len(names), "n_ids": held}])
            number, held = number + 1, 0
            names.clear()
            parts.clear()
            return row

        for batch in batches:
            for some, _, _ in runs(batch, size=BATCH):
                for doc, ids in zip(some["doc_id"].to_pylist(), enc.encode_all(some["text"])):
                    names.append(doc)
                    parts.append(np.concatenate((ids.astype(kind, copy=False), end)))
                    held += len(parts[-1])
                    if held >= SHARD:
                        yield flush()
        if names:
            yield flush()

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the files; a row for each: its place in the order, its path and its counts.

    Documents are parted by ranges of id, with the length of the text as second key, so
    even an id that many rows share is split; rows alike in both follow a hash of the text.
    """
    plain = only(docs, doc_id="bigint", text="string")
    keys = [F.col("doc_id").asc_nulls_first(), F.octet_length("text").asc_nulls_first()]
    ordered = plain.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64("text"))
    return ordered.mapInArrow(_write(folder, vocabulary, end_id), "part bigint, number bigint, file string, n_docs bigint, n_ids bigint")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
            shard = open_shard(path)
            for at in range(0, shard.count, READ):
                stop = min(at + READ, shard.count)
                bounds = shard.bounds.select_many(at, stop + 1)
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [shard.doc_ids(at, stop), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the files: its id, where it starts in the whole corpus, its length and checksum.

    The running sum is over one row for each file, of some 32 million ids each.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    # A number keeps adaptive execution from putting the files, which are few rows, into one task.
    files = max(1, manifest.count())
    return placed.repartition(files, "file").select("file", "base").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_corpus(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the files to a fresh shared folder and read every document back from them."""
    scratch = Scratch(docs.sparkSession, "ids")
    return read_ids(scratch.save(write_ids(docs, scratch.folder("files"), vocabulary, end_id), "manifest"))
