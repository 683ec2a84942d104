"""Token-ID output: concatenated ids with Elias-Fano coded document boundaries.

A shard is one binary value: a header, the ids of its documents one after another (16-bit where the
vocabulary allows, else 32-bit, little-endian) and the documents' end offsets, Elias-Fano coded. For n
offsets up to u, each offset's low ``floor(log2(u / n))`` bits are packed side by side and its high
bits stand in unary in a bitmap: about ``2 + log2(u / n)`` bits a document. ``select`` finds an offset
from a sample of every 256th one bit, 32 bits each; there is no table of 64-bit offsets. The document ids, which
ascend too, stand behind them in the same code.

Shards are rows ``(part, chunk, n_docs, n_ids, payload)`` of a Parquet table, in ascending document
order by ``(part, chunk)``. A chunk ends at ``chunk_ids`` ids, so a very long document ends its chunk.

Edge cases: null text is empty and has its end id only; rows with equal doc_id follow each other,
ordered by text hash (repeated rows are equal, so their order is none); null doc_ids come first; an empty table gives
no shard; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions, stash, texts

MAGIC, SAMPLE = b"EFID", 256
SHARDS = "part int, chunk int, n_docs bigint, n_ids bigint, payload binary"


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``last``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((last >> low_bits) + n + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bits = i[:, None] * self.low_bits + np.arange(self.low_bits)
        found = (self.low[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        return (found.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else np.zeros(len(i), np.int64)

    def select(self, i: int) -> int:
        """Value i, from the sampled one bit before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_range(i, i + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last - 1``: from the sampled one bit before the first, the bitmap is read on as far as it takes."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.empty(0, np.int64)
        at, skip, want = int(self.samples[first // SAMPLE]), first % SAMPLE, last - first // SAMPLE * SAMPLE
        byte, width = at >> 3, 64 + (want >> 2)
        while True:
            flags = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            flags[: at & 7] = 0
            ones = np.flatnonzero(flags)
            if len(ones) >= want:
                index = np.arange(first, last)
                return ((byte * 8 + ones[skip:want] - index) << self.low_bits) | self._low(index)
            width *= 2

    def decode(self) -> np.ndarray:
        """All values, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        index = np.arange(self.n)
        return ((ones - index) << self.low_bits) | self._low(index)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low_bits, lows, highs, samples = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        low, high = np.frombuffer(data, np.uint8, lows, at), np.frombuffer(data, np.uint8, highs, at + lows)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", samples, at + lows + highs))


def bytes_of(largest: int) -> int:
    """Bytes of an id if the largest is so large."""
    return 2 if largest < 1 << 16 else 4


def write_shard(ids: np.ndarray, ends: np.ndarray, id_bytes: int, keys: bytes = b"") -> bytes:
    """One shard's bytes; ``ends``: each document's end in ``ids``; ``keys``: coded document ids."""
    if len(ids) and int(ids.max()) >= 1 << 8 * id_bytes:
        raise ValueError(f"id {int(ids.max())} does not fit {id_bytes} bytes")
    offsets = EliasFano.encode(ends).to_bytes()
    return MAGIC + struct.pack("<BQQ", id_bytes, len(ids), len(offsets)) + ids.astype(f"<u{id_bytes}").tobytes() + offsets + keys


def read_shard(data: bytes) -> tuple[np.ndarray, EliasFano, memoryview]:
    """(ids, documents' ends, coded document ids)."""
    view = memoryview(data)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token shard")
    id_bytes, n, size = struct.unpack_from("<BQQ", view, 4)
    at = 4 + struct.calcsize("<BQQ")
    ids = np.frombuffer(view, f"<u{id_bytes}", n, at)
    at += n * id_bytes
    return ids, EliasFano.from_bytes(view[at : at + size]), view[at + size :]


def code_keys(keys: list[int | None]) -> bytes:
    """Ascending document ids, nulls first: how many nulls, the first id, and what the others are more, Elias-Fano coded."""
    known = [k for k in keys if k is not None]
    first = known[0] if known else 0
    more = EliasFano.encode(np.array([k - first for k in known], np.uint64)).to_bytes()
    return struct.pack("<Qq", len(keys) - len(known), first) + more


def read_keys(data: memoryview) -> list[int | None]:
    nulls, first = struct.unpack_from("<Qq", data)
    code = EliasFano.from_bytes(data[struct.calcsize("<Qq") :])
    return [None] * nulls + [first + k for k in code.select_range(0, code.n).astype(np.uint64).tolist()]


def encode_shards(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = None, chunk_ids: int = 1 << 21, id_bytes: int | None = None) -> DataFrame:
    """Shard rows of a corpus ``(doc_id, text)``: ranges of doc_id are dealt out, each is sorted and encoded.

    ``id_bytes``: bytes of an id; if none is given, two where the vocabulary and ``end_id`` allow, else four. An id that
    does not fit is an error.
    """
    keyed = texts(docs).withColumn("salt", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(partitions(docs.sparkSession), "doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text").select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .bpe import encoder

        coder, part, chunk = encoder(tokenizer), TaskContext.get().partitionId(), 0
        wide = id_bytes or bytes_of(max(coder.largest_id, end_id or 0))
        doc_ids, held, sizes, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = write_shard(np.concatenate(held), np.cumsum(sizes), wide, code_keys(doc_ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())], names=["part", "chunk", "n_docs", "n_ids", "payload"])

        for keys, words in slices(batches):
            ids, offsets = coder.encode(words)
            if end_id is not None:
                ids, offsets = np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
            for i, key in enumerate(keys):
                doc_ids.append(key)
                held.append(ids[offsets[i] : offsets[i + 1]])
                sizes.append(int(offsets[i + 1] - offsets[i]))
                total += sizes[-1]
                if total >= chunk_ids:
                    yield flush()
                    doc_ids, held, sizes, total, chunk = [], [], [], 0, chunk + 1
        if doc_ids:
            yield flush()

    return map_arrow(ordered, shards, SHARDS)


def cuts(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of an array of texts or bytes that hold ``size`` bytes at most, unless one value has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, end
        at = end


def slices(batches: Iterator[pa.RecordBatch], chars: int = 1 << 18) -> Iterator[tuple[list, list[str]]]:
    """Arrow batches of ``(key, text)`` in slices of about ``chars`` characters at most, to bound memory."""
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        for a, b in cuts(column, chars):
            yield keys.slice(a, b - a).to_pylist(), column.slice(a, b - a).to_pylist()


def text_slices(column: pa.Array, chars: int = 1 << 18) -> Iterator[list]:
    """One array of texts in slices as those of ``slices``."""
    for a, b in cuts(column, chars):
        yield column.slice(a, b - a).to_pylist()


def write_corpus(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes a corpus's shards to ``path`` (the shared folder if none) and returns the table read back."""
    shards = encode_shards(docs, **options)
    if path is None:
        return stash(shards, "tokens")
    shards.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(SHARDS).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``(part, chunk, base)``: ids before each shard; a sum over parts, then one within each part."""
    sizes = shards.select("part", "chunk", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = sizes.select("part", "chunk", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")).alias("within"))
    return inner.join(before, "part").select("part", "chunk", (F.col("before") + F.col("within")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the shards."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, offsets, coded = read_shard(payload.as_py())
                keys = read_keys(coded)
                for a in range(0, offsets.n, 1 << 16):  # offsets come from the select structure, some at a time
                    ends = offsets.select_range(a, min(offsets.n, a + (1 << 16)))
                    n, first = len(ends), offsets.select(a - 1) if a else 0
                    starts = np.concatenate([[first], ends[:-1]]).astype(np.int64)
                    raw = memoryview(ids[first : int(ends[-1])].astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (x - first) : 4 * (y - first)]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([chunk.as_py()] * n, pa.int32()), pa.array(keys[a : a + n], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["part", "chunk", "doc_id", "within", "n_tokens", "ids_crc32"])

    read = map_arrow(shards.select("part", "chunk", "payload"), documents, "part int, chunk int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(shard_starts(shards), ["part", "chunk"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
