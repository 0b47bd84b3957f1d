"""Token ids in binary files: one id array, with Elias-Fano coded document boundaries and document ids.

A file holds documents in ascending id order. Layout, little-endian throughout:

``EFID`` | u32 id width in bytes | u64 documents | u64 ids | boundaries | document ids | id array

The two sequences are Elias-Fano coded: ``u64 first | u64 universe | u64 n | u8 low bits | low parts | high parts
in unary | u32 bit position of each 256th one``. A boundary is found by ``select`` from the nearest sample, so
offsets take about ``2 + log2(ids / documents)`` bits each and no table of 64-bit offsets exists.
"""
from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import BpeModel, byte_letters, worker_encoder
from .common import scratch, sliced, stored, text_bytes

MAGIC = b"EFID"
#: Ones between two samples of the select structure, and the ids after which a file is closed.
SAMPLE, FILE_IDS = 256, 1 << 21
#: Bytes of text one range of ids is meant to hold.
RANGE_BYTES = 64 << 20
#: Ones in each byte, and the place of each one in it.
_COUNT = np.array([i.bit_count() for i in range(256)])
_PLACE = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)])
_HEAD = struct.Struct("<QQQB")


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence; ``first`` is taken off before coding."""
    first: int
    universe: int
    n: int
    low_bits: int
    low: np.ndarray  # bytes
    high: np.ndarray  # bytes
    samples: np.ndarray  # bit position of one number 0, 256, 512, ...

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        first = int(values[0]) if n else 0
        rest = (values - first).astype(np.uint64) if n else np.zeros(0, np.uint64)
        universe = int(rest[-1]) if n else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.packbits(((rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        marks[ones] = 1
        return cls(first, universe, n, bits, low, np.packbits(marks, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Value number ``i`` without decoding the others."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while left >= (count := word.bit_count()):
            left -= count
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        begin = i * self.low_bits
        span = bytes(self.low[begin >> 3:(begin + self.low_bits + 7) >> 3])
        low = (int.from_bytes(span, "little") >> (begin & 7)) & ((1 << self.low_bits) - 1)
        return self.first + (high << self.low_bits | low)

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """Values number ``i`` of any places: the byte of each one by a running count, then its place in the byte."""
        upto = np.cumsum(_COUNT[self.high])
        byte = np.searchsorted(upto, i, side="right")
        high = byte * 8 + _PLACE[self.high[byte], i - (upto[byte] - _COUNT[self.high[byte]])] - i
        begin = i.astype(np.int64) * self.low_bits
        padded = np.concatenate((self.low, np.zeros(9, np.uint8))).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for k in range(8):
            word |= padded[(begin >> 3) + k] << np.uint64(8 * k)
        word >>= (begin & 7).astype(np.uint64)
        if self.low_bits > 57:  # the parts may reach into a ninth byte
            return np.array([self.select(int(x)) for x in i], np.int64)
        low = word & np.uint64((1 << self.low_bits) - 1)
        return self.first + (high.astype(np.int64) << self.low_bits | low.astype(np.int64))

    def values(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return self.first + ((high.astype(np.int64) << self.low_bits) | low)

    def to_bytes(self) -> bytes:
        return (_HEAD.pack(self.first & (1 << 64) - 1, self.universe, self.n, self.low_bits)
                + struct.pack("<QQ", len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes())

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        first, universe, n, bits = _HEAD.unpack_from(data, at)
        low, high = struct.unpack_from("<QQ", data, at + _HEAD.size)
        at += _HEAD.size + 16
        samples = -(-n // SAMPLE)
        out = cls(first - (1 << 64) if first >> 63 else first, universe, n, bits, np.frombuffer(data, np.uint8, low, at),
                  np.frombuffer(data, np.uint8, high, at + low), np.frombuffer(data, "<u4", samples, at + low + high))
        return out, at + low + high + 4 * samples


@dataclass(frozen=True)
class TokenFile:
    doc_ids: EliasFano
    boundaries: EliasFano  # one more than documents
    ids: np.ndarray

    @classmethod
    def of(cls, doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> TokenFile:
        ends = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
        return cls(EliasFano.of(np.array(doc_ids, np.int64)), EliasFano.of(ends), ids)

    def to_bytes(self) -> bytes:
        width = 2 if not len(self.ids) or int(self.ids.max()) < 1 << 16 else 4
        return (MAGIC + struct.pack("<IQQ", width, self.doc_ids.n, len(self.ids)) + self.boundaries.to_bytes()
                + self.doc_ids.to_bytes() + self.ids.astype(f"<u{width}").tobytes())

    @classmethod
    def read(cls, data: bytes) -> TokenFile:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        width, _, n = struct.unpack_from("<IQQ", data, 4)
        boundaries, at = EliasFano.read(data, 24)
        doc_ids, at = EliasFano.read(data, at)
        return cls(doc_ids, boundaries, np.frombuffer(data, f"<u{width}", n, at))

    def document(self, k: int) -> np.ndarray:
        """Ids of document number ``k``."""
        return self.ids[self.boundaries.select(k):self.boundaries.select(k + 1)]


def library_words(model: BpeModel) -> Callable[[list[str]], list[bytes]]:
    """Ids of words by the tokenizers library's model; splitting and normalising are done before."""
    merge, letters = model.library.model.tokenize, str.maketrans({chr(i): x for i, x in enumerate(byte_letters())})

    def ids(word: str) -> bytes:
        if word in model.special:
            return array("I", [model.special[word]]).tobytes()
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in merge(word)]).tobytes()

    return lambda words: list(map(ids, words))


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, add the id ``end``, and write token files in ascending document order below ``path``.

    ``tokenizer`` is the definition (JSON) of a word-wise vocabulary: one that splits at white space and drops
    it. Files are rows ``(part, seq, n_docs, n_ids, payload)`` of a Parquet table, so any store that Spark can
    write to holds them and a lost executor leaves no half-written file; ``part`` and ``seq`` give their order.
    Null and empty texts hold only the end id; repeated ids stand side by side; rows with a null id are left
    out; an empty table writes no file. A partition is one range of ids, cut into files of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, seq = worker_encoder(shared.value, library_words), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        doc_ids, lengths, kept, size = [], [], [], 0

        def closed():
            ids = np.concatenate(kept)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([TokenFile.of(doc_ids, lengths, ids).to_bytes()], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])

        for b in sliced(batches, 60):  # the pieces of a slice stay in the processor's cache
            for key, flat in zip(b.column(0).to_pylist(), encoder.encode(text_bytes(b.column(1)))):
                ids = np.frombuffer(flat + last, "<u4")
                doc_ids.append(key)
                lengths.append(len(ids))
                kept.append(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids)
                size += len(ids)
                if size >= FILE_IDS:
                    yield closed()
                    doc_ids, lengths, kept, size, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield closed()

    # equal ids may go to several ranges: the hash of the text is a second key
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    order = ["id", F.xxhash64("text")]
    # the number of ranges follows from the bytes, not from the session, so a range fits a task at any size
    ranges = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    ranges = max(ranges, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "text")
    rows.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document of the files below ``path``.

    With ``digest``, the unsigned crc32 of the ids as little-endian 32-bit integers, ``ids_crc32``, takes the
    place of the ids.
    """
    files = spark.read.parquet(path)
    # offsets in two steps, first within a part, then over the parts: no task sees all files
    within = W.partitionBy("part").orderBy("seq")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    starts = files.select("part", "seq", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("own")).join(before, "part")
    starts = stored(starts.select("part", "seq", (F.col("own") + F.col("before")).alias("start")), "file-starts")

    name, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")

    def run(batches):
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file = TokenFile.read(data)
                cuts = file.boundaries.select_many(np.arange(file.boundaries.n))
                if digest:
                    wide = file.ids.astype("<u4")
                    last = pa.array([crc32(wide[x:y].tobytes()) for x, y in zip(cuts, cuts[1:])], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(file.ids.astype(np.int32)))
                table = pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids.select_many(np.arange(file.doc_ids.n))), pa.array(cuts[:-1] + start), pa.array(np.diff(cuts)), last], names=["doc_id", "start", "n_tokens", name])
                for at in range(0, table.num_rows, 500):
                    yield table.slice(at, 500)

    placed = files.select("part", "seq", "payload").join(starts, ["part", "seq"]).select("start", "payload")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")


def token_file_digest(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below the shared folder, read them again, and return the digest of each document."""
    path = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, end, id_col, text_col)
    return read_token_files(docs.sparkSession, path, digest=True)
