"""Benchmark decontamination by spaced-seed hashing of token windows."""
from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import sliced, text_bytes

#: Tokens of an aligned window, and how many of them have to be equal (0.8 or more).
WINDOW, EQUAL = 13, 11
#: Positions each mask compares. Whichever two of the 13 tokens are substituted, one of these masks finds a
#: place in the window where it meets neither (a test tries all pairs).
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 3, 6, 8, 9, 10), (0, 1, 3, 4, 5, 8, 9))
#: Shortest passage that counts as evidence; passages of 5 to 12 tokens have to occur whole and unchanged.
SHORTEST = 5
#: Bits of the filter of test hashes that is sent to all tasks: 8 MB whatever the size of the benchmark.
FILTER_BITS = 26

_TABLE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_SPAN = max(m[-1] for m in MASKS) + 1
_BEFORE, _AFTER = WINDOW - 1, WINDOW + _SPAN
_MIX = np.random.default_rng(3).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def token_codes(lowered: bytes) -> np.ndarray:
    """A 32-bit code of each token: runs of letters and digits, ASCII punctuation and space between them."""
    words = lowered.translate(_TABLE).split()
    return np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def seed_hashes(mixed: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the unmasked tokens at each start where the mask fits."""
    n = len(mixed) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask) * 1_000_003 + mask[-1], np.uint64)
    for k in mask:
        total += mixed[k:k + n] * _MIX[k]
    return (total ^ (total >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)


def _whole(n: int) -> tuple[int, ...]:
    return tuple(range(n))


def _context(codes: np.ndarray, at: int) -> tuple[bytes, int]:
    """Tokens around a hit, and how many of them stand before it."""
    first = max(0, at - _BEFORE)
    return codes[first:at + _AFTER].tobytes(), at - first


_SCHEMA = "id long, hash long, at long, before int, tokens binary, length int"


def _test_seeds(items: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), text_bytes(pc.utf8_lower(b.column(1)))):
                codes = token_codes(text)
                if len(codes) < SHORTEST:
                    continue
                mixed = _mixed(codes)
                for mask in MASKS if len(codes) >= WINDOW else (_whole(len(codes)),):
                    for at, h in enumerate(seed_hashes(mixed, mask).view(np.int64).tolist()):
                        rows.append((i, h, at, *_context(codes, at)[::-1], len(codes)))
            yield _batch(rows)

    return items.mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["id", "hash", "at", "before", "tokens", "length"])


def _filter_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _document_seeds(docs: DataFrame, bits, masks: list[tuple[int, ...]]) -> DataFrame:
    def run(batches):
        table = np.frombuffer(bits.value, np.uint8)
        for b in sliced(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), text_bytes(pc.utf8_lower(b.column(1)))):
                codes = token_codes(text)
                mixed = _mixed(codes)
                for mask in masks:
                    h = seed_hashes(mixed, mask)
                    slot = _filter_slot(h)
                    for at in np.flatnonzero((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).tolist():
                        rows.append((i, int(h[at].view(np.int64)), at, *_context(codes, at)[::-1], len(codes)))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return docs.mapInArrow(run, _SCHEMA)


def _filter_of(seeds: DataFrame) -> bytes:
    """Bitmap of the test hashes: collected as its set words, at most 2 ** (FILTER_BITS - 6) of them."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = (
        seeds.select(F.shiftright(slot, 5).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, %d) & 31 as int))" % (64 - FILTER_BITS)).alias("bit"))
        .groupBy("w").agg(F.bit_or("bit").alias("v")).collect())
    bits = np.zeros(1 << (FILTER_BITS - 5), "<u4")
    for r in words:
        bits[r.w] = r.v
    return bits.tobytes()


def best_window(doc: np.ndarray, item: np.ndarray, window: int) -> tuple[int, int, int]:
    """Most equal tokens in an aligned window, and where the first and the last such window start."""
    equal = np.concatenate(([0], np.cumsum(doc == item)))
    sums = equal[window:] - equal[:-window]
    at = int(sums.argmax())
    return int(sums[at]), at, len(sums) - 1 - int(sums[::-1].argmax())


def _verified(joined: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            out = []
            for d, i, at, before, tokens, i_before, i_tokens, length in zip(*(c[n] for n in ("id", "item_id", "at", "before", "tokens", "i_before", "i_tokens", "length"))):
                x, y = np.frombuffer(tokens, np.uint32), np.frombuffer(i_tokens, np.uint32)
                lead = min(before, i_before)
                x, y = x[before - lead:], y[i_before - lead:]
                n, window = min(len(x), len(y)), min(WINDOW, length)
                if n < window:
                    continue
                equal, first, last = best_window(x[:n], y[:n], window)
                if equal >= (EQUAL if length >= WINDOW else length):
                    out.append((d, i, at - lead + first, at - lead + last + window - 1, equal))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["id", "item_id", "at", "upto", "equal"])

    return joined.mapInArrow(run, "id long, item_id long, at long, upto long, equal int")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, item, first_token, last_token, most_equal)`` of each document that holds a benchmark passage.

    A passage is held when 11 of 13 aligned successive tokens are equal, case and punctuation aside; passages
    of 5 to 12 tokens have to occur unchanged; shorter ones are no evidence. Masks leave out positions, so a
    window with up to two substituted tokens shares a seed hash with its original. Seeds of documents pass a
    filter of fixed size, then join the test seeds; each hit carries the tokens around it, so the overlap is
    verified where the hit is and no text is moved. Items with equal text count as the smallest item.

    Null texts hold nothing; rows with a null id are left out; repeated ids are taken together; empty tables
    give no rows; other columns play no part.
    """
    spark = docs.sparkSession
    tests = (
        items.select(F.col(item_text_col).alias("text"), F.col(item_col).cast("long").alias("item")).where("text is not null and item is not null")
        .groupBy("text").agg(F.min("item").alias("id")).select("id", "text"))
    seeds = _test_seeds(tests)
    short = [r.length for r in seeds.where(F.col("length") < WINDOW).select("length").distinct().collect()]  # 8 values at most
    masks = list(MASKS) + [_whole(n) for n in sorted(short)]
    bits = spark.sparkContext.broadcast(_filter_of(seeds))
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = _document_seeds(kept, bits, masks).drop("length")
    right = seeds.select("hash", F.col("id").alias("item_id"), F.col("before").alias("i_before"), F.col("tokens").alias("i_tokens"), "length").distinct()
    # seeds are many times their items, so sizes estimated from the items must not choose a broadcast; a join by
    # exchange also ends the stage, so a task runs one Python worker, not one for the seeds and one for the overlaps
    checked = _verified(found.join(right.hint("merge"), "hash"))
    return (
        checked.groupBy("id", "item_id")
        .agg(F.min("at").alias("first_token"), F.max("upto").alias("last_token"), F.max("equal").alias("most_equal"))
        .select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "first_token", "last_token", "most_equal"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns kept; rows with a null id stay."""
    bad = contaminated(docs, items, id_col, text_col).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad["_bad"], "left_anti")
