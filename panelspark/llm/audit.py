"""How filters of a corpus interact: what each removes in every order, alone and beside the others.

Texts that nothing repeats are cleared by a counting Bloom filter before any text moves: partial sketches of the
partitions are added slot by slot, and a text whose slots are not all counted twice is unique for sure. Only the
other texts are shuffled, whole, for the smallest id of each. What a document fails is a bit mask; the audit of
all orders is a sum over the few masks of each part.
"""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import sliced, stored, text_bytes

#: Slots of the sketch for each document, hashes of a text, slots of one chunk, and the most slots a sketch takes.
SLOTS_PER_ROW, HASHES, CHUNK, MOST_SLOTS = 8, 3, 1 << 16, 1 << 31
#: Hashes that a task gathers before it emits a part of its sketch.
FLUSH = 1 << 20


def text_filters() -> dict[str, Column | None]:
    """Conditions over ``text_measures`` that remove a document, by letter; None: equal to the text of a smaller id.

    A: under 100 words; B: distinct words under 80 % of the words; C: over 10 % capitals A-Z; D: a character of
    ``#$%&*|``; E: a repeated text. Words are runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive.
    """
    n = F.col
    return {"A": n("words") < 100, "B": 100 * n("distinct") < 80 * n("words"), "C": 100 * n("capitals") > 10 * n("points"), "D": n("symbols") > 0, "E": None}


_MEASURES = ["words", "distinct", "capitals", "points", "symbols"]
_NOT_CAPITALS = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#$%&*|")


def text_measures(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with counts in the place of the text: words, distinct words, capitals, code points, symbols; null is empty."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches):
        for b in sliced(batches):
            texts = text_bytes(b.column(len(kept)))
            words = [t.split() for t in texts]  # bytes split at exactly the six ASCII spaces
            counts = [list(map(len, words)), [len(set(w)) for w in words], [len(t.translate(None, _NOT_CAPITALS)) for t in texts],
                      [len(t.decode()) for t in texts], [len(t.translate(None, _NOT_SYMBOLS)) for t in texts]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in counts)], names=kept + _MEASURES)

    schema = ", ".join([f"`{c}` {t}" for c, t in rows.select(kept).dtypes] + [f"{m} long" for m in _MEASURES])
    return rows.select(*kept, text_col).mapInArrow(run, schema)


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Slots of each hash, one row a hash; the step between them is an odd number made of the hash."""
    h = hashes.astype(np.uint64)
    step = (h * np.uint64(0x9E3779B97F4A7C15) ^ h >> np.uint64(29)) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(slots - 1)


def slot_count(rows: int) -> int:
    """A power of two: at least 8 slots a row, until the sketch has reached its largest size (256 MB of bits)."""
    return min(MOST_SLOTS, max(CHUNK, 1 << (SLOTS_PER_ROW * rows - 1).bit_length()))


def repeat_sketch(hashes: DataFrame, slots: int) -> np.ndarray:
    """One bit a slot, packed: 1 where at least two rows of ``hashes`` (one long column) count in the slot.

    Tasks count their own rows and emit the touched slots of each chunk; chunks are added across tasks. Equal
    hashes count as often as they stand there, so one that comes twice has all its bits.
    """

    def partial(batches):
        held, size = [], 0

        def counted():
            places, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.flatnonzero(np.diff(places // CHUNK, prepend=-1))
            ends = [*cuts[1:].tolist(), len(places)]
            low, sure = (places % CHUNK).astype("<u2"), np.minimum(counts, 2).astype(np.uint8)
            for at in range(0, len(cuts), 256):
                some = list(zip(cuts[at:at + 256].tolist(), ends[at:at + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(places[a]) // CHUNK for a, _ in some], pa.int32()), pa.array([low[a:b].tobytes() for a, b in some], pa.binary()),
                     pa.array([sure[a:b].tobytes() for a, b in some], pa.binary())], names=["chunk", "places", "counts"])

        for b in batches:
            if b.num_rows:
                held.append(_slots(b.column(0).to_numpy(zero_copy_only=False), slots).ravel().astype(np.int64))
                size += len(held[-1])
            if size >= FLUSH:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    def merged(key, table):
        total = np.zeros(CHUNK, np.int64)
        for places, counts in zip(table.column("places").to_pylist(), table.column("counts").to_pylist()):
            total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary())})

    parts = hashes.mapInArrow(partial, "chunk int, places binary, counts binary")
    sketch = np.zeros(slots // 8, np.uint8)
    for row in parts.groupBy("chunk").applyInArrow(merged, "chunk int, bits binary").collect():
        at = row.chunk * (CHUNK // 8)
        sketch[at:at + CHUNK // 8] = np.frombuffer(row.bits, np.uint8)
    return sketch


def maybe_repeated(spark, sketch: np.ndarray):
    """Function of a hash column: false where the sketch proves that no other row has the hash."""
    shared, slots = spark.sparkContext.broadcast(sketch), 8 * len(sketch)

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd
        places = _slots(h.to_numpy(), slots).astype(np.int64)
        return pd.Series(((shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1))

    return test


def orders_of(letters: str) -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, bit, before)`` of every step of every order; ``before`` is the mask of earlier filters."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return [("".join(order), s + 1, bit[x], sum(bit[y] for y in order[:s])) for order in permutations(letters) for s, x in enumerate(order)]


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, Column | None] | None = None,
                  id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``, all
    counts within the part. ``filters`` maps letters to failing conditions over the columns of ``docs``; at most
    one value is None, the filter of repeated texts; without it the five of ``text_filters`` hold. Defined results: a null text is an empty one; a null part is
    the empty string; a null condition does not fail; a null id is smaller or larger than no other; rows of one
    id and text are not repeats of each other; a document with several label rows is good (toxic) if one of them
    says so; other columns are not read unless a condition names them; no documents give no rows.
    The sketch grows with the table up to 256 MB; past 268 million rows it clears ever fewer texts, which are then
    shuffled and compared all the same.
    """
    measured = filters is None
    filters = text_filters() if measured else filters
    spark, letters = docs.sparkSession, "".join(filters)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values()) if c is not None), F.lit(0))
    head = [F.col(id_col).alias("key"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h")]
    flags = text_measures(docs.select(*head, text.alias("text"))).select("key", "part", "h", mask.alias("mask")) if measured else docs.select(*head, mask.alias("mask"))
    marks = labels.groupBy(F.col(id_col).alias("key")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = stored(flags.join(marks, "key", "left").select(
        "key", "part", "mask", "h", F.coalesce("good", F.lit(False)).cast("int").alias("good"), F.coalesce("toxic", F.lit(False)).cast("int").alias("toxic")), "flags")
    shares = flags.select("part", "mask", F.lit(1).alias("n"), "good", "toxic")

    whole = [1 << i for i, c in enumerate(filters.values()) if c is None]
    if whole:
        (bit,) = whole
        repeated = maybe_repeated(spark, repeat_sketch(flags.select("h"), slot_count(flags.count())))
        texts = docs.select(F.col(id_col).alias("key"), text.alias("text"), F.xxhash64(text).alias("h")).where(repeated("h"))
        first = texts.groupBy("text").agg(F.min("key").alias("key"), F.first("h").alias("h")).select("key", "h")
        # a possible repeat that is not the smallest id of its text fails: it moves from one mask to another
        later = flags.where("key is not null").where(repeated("h")).join(first, ["key", "h"], "left_anti")
        moves = F.explode(F.array(F.struct(F.lit(0).alias("b"), F.lit(-1).alias("n")), F.struct(F.lit(bit).alias("b"), F.lit(1).alias("n"))))
        moved = later.select("part", "mask", "good", "toxic", moves.alias("x")).select(
            "part", F.col("mask").bitwiseOR(F.col("x.b")).alias("mask"), F.col("x.n").alias("n"),
            (F.col("good") * F.col("x.n")).alias("good"), (F.col("toxic") * F.col("x.n")).alias("toxic"))
        shares = shares.unionByName(moved)
    counts = shares.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return _all_orders(counts, letters)


def _all_orders(counts: DataFrame, letters: str) -> DataFrame:
    """The audit from the counts of each part and mask; the steps of all orders are a table of fixed size."""
    steps = counts.sparkSession.createDataFrame(orders_of(letters), "filter_order string, step int, bit int, before int")
    steps = steps.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(letters)) - 1))))
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, column: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    out = counts.join(F.broadcast(steps), "mask").groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")
