"""Scans along series that may be larger than a task, and folds with a constant state.

A series is cut into blocks by one range exchange on its keys and order. Inside a block, prefixes are composed by
doubling; one small row per key and block closes the gap between blocks; both meet in a broadcast of at most two
rows a block. No row carries a list, and no task holds a series.
"""
from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

c = F.col


def key_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows of a batch whose key differs from the row before; the first row always counts."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def key_of(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(k))[int(row)].as_py() for k in keys)


def compose(start: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of the maps ``y -> a y + b`` of every segment, by doubling.

    ``start[i]`` is the first row of row i's segment. ``first`` is the value a map gives to a series that has none
    yet (NaN: it stays without). Returns the same three of all maps from the segment's start to each row.
    """
    n, step = len(a), 1
    at = np.arange(n)
    longest = int((at - start).max(initial=0)) + 1
    while step < longest:
        i = np.flatnonzero(at - step >= start)
        j = i - step
        new = np.where(np.isnan(first[j]), first[i], a[i] * first[j] + b[i])
        nb, na = a[i] * b[j] + b[i], a[i] * a[j]
        first, a, b = first.copy(), a.copy(), b.copy()
        first[i], a[i], b[i] = new, na, nb
        step *= 2
    return first, a, b


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str | None, gain: float, partitions: int | None, stem: str) -> DataFrame:
    """The rows in their blocks, written once: place in key and block, prefix maps, and a mark on the last row of each key."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, names = list(keys), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state, held = TaskContext.get().partitionId(), None, None  # state: key, rows, first, a, b up to the last row

        def out(batch, columns, ends):
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, block, np.int32)), *map(pa.array, columns), pa.array(ends)],
                                              names=[*names, "_block", "_at", "_first", "_a", "_b", "_end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            n, starts = batch.num_rows, key_starts(batch, keys)
            start = np.repeat(starts, np.diff(np.append(starts, n)))
            v = batch.column(names.index(x)).to_numpy(zero_copy_only=False).astype(float) if x else np.full(n, np.nan)
            known = ~np.isnan(v)
            first, a, b = compose(start, v, np.where(known, 1.0 - gain, 1.0), np.where(known, gain * v, 0.0))
            at = np.arange(n) - start + 1
            same = state is not None and state[0] == key_of(batch, keys, 0)
            if same:
                head = slice(0, starts[1] if len(starts) > 1 else n)
                _, rows, f0, a0, b0 = state
                first[head] = np.where(np.isnan(f0), first[head], a[head] * f0 + b[head])
                b[head] = a[head] * b0 + b[head]
                a[head] *= a0
                at[head] += rows
            if held is not None:  # the last row waits until it is known whether its key goes on
                held[2][-1] = not same
                yield out(*held)
            ends = np.zeros(n, bool)
            ends[starts[1:] - 1] = True
            held = [batch, (at.astype(np.int64), first, a, b), ends]
            state = (key_of(batch, keys, n - 1), int(at[-1]), first[-1], a[-1], b[-1])
        if held is not None:
            held[2][-1] = True
            yield out(*held)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    rows = df.repartitionByRange(partitions, *keys, *order).sortWithinPartitions(*keys, *order)
    return stored(spark, rows.mapInArrow(run, f"{fields}, _block int, _at long, _first double, _a double, _b double, _end boolean"), stem)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """``row_number`` of every row in its series, whatever the length of the series; equal rows in any order."""
    rows = _blocks(df, keys, order, None, 0.0, partitions, "numbered")
    w = Window.partitionBy(*keys).orderBy("_block")
    offsets = rows.where("_end").select(*keys, "_block", (F.sum("_at").over(w) - c("_at")).alias("_before")).where("_before > 0")
    joined = _meet(rows, offsets, keys, "_before")
    return joined.select(*df.columns, (c("_at") + F.coalesce("_before", F.lit(0))).alias(out))


def _meet(rows: DataFrame, small: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``value`` of each key and block on the rows; ``small`` has two rows a block at most."""
    named = small.select(c("_block").alias("_kb"), *[c(k).alias(f"_k{i}") for i, k in enumerate(keys)], value)
    same = c("_block") == c("_kb")
    for i, k in enumerate(keys):
        same = same & c(k).eqNullSafe(c(f"_k{i}"))
    return rows.join(F.broadcast(named), same, "left")


def ewm_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, alpha: float, out: str, partitions: int | None = None) -> DataFrame:
    """``y = (1 - alpha) y' + alpha x`` along every series, seeded with its first known value; unknown values keep ``y``.

    Null until a value is known. A null key is a series too; NaN counts as unknown; an empty table gives no rows.
    """
    rows = _blocks(df.withColumn(x, c(x).cast("double")), keys, order, x, alpha, partitions, "scanned")
    ends = rows.where("_end").select(*keys, "_block", F.nanvl("_first", F.lit(None)).alias("_first"), "_a", "_b")
    several = ends.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_blocks > 1").drop("_blocks")
    types = ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes)

    def closed(table):  # the blocks of one series, in order
        table = table.sort_by("_block")
        carry, value = [], None
        for f, a, b in zip(*(table.column(n).to_pylist() for n in ("_first", "_a", "_b"))):
            carry.append(value)
            value = f if value is None else a * value + b
        return table.select([*keys, "_block"]).append_column("_carry", pa.array(carry, pa.float64()))

    carried_in = several.groupBy(*keys).applyInArrow(closed, f"{types}, _block int, _carry double").where("_carry IS NOT NULL")
    value = F.when(c("_carry").isNull(), F.nanvl("_first", F.lit(None))).otherwise(c("_a") * c("_carry") + c("_b"))
    return _meet(rows, carried_in, keys, "_carry").select(*df.columns, value.alias(out))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """A fold along every series with a state of constant size; rows stream in order, one series after the other.

    ``fold()`` gives ``(step, end)`` for one series: ``step(row tuple)`` and ``end()`` return the rows to emit, as
    tuples of ``schema``. A series is bounded by its number of dates, so it goes to one task; no series is held.
    """
    keys = list(keys)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    wanted = schema_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, end = None, None, None
        at = None
        for batch in batches:
            at = at or [batch.schema.get_field_index(k) for k in keys]
            emitted = []
            for row in zip(*(col.to_pylist() for col in batch.columns)):
                now = tuple(row[i] for i in at)
                if now != key or step is None:
                    if end is not None:
                        emitted += end()
                    key = now
                    step, end = fold()
                emitted += step(row)
            if emitted:
                yield pa.RecordBatch.from_pylist([dict(zip(wanted.names, r)) for r in emitted], wanted)
        if end is not None and (emitted := end()):
            yield pa.RecordBatch.from_pylist([dict(zip(wanted.names, r)) for r in emitted], wanted)

    return rows.mapInArrow(run, schema)


def schema_types(schema: str) -> pa.Schema:
    """The Arrow form of a schema given as text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))
