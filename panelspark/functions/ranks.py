"""Cross-sectional ranks and quantiles."""
from __future__ import annotations

from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .columns import safe_div


def rank_pct(x, by: Sequence[str] = ("date",)) -> Column:
    """Average rank over the count of non-null values, in (0, 1]; null for null.

    Average rank = mean of the first and the last place a tie occupies. One sort per group.
    """
    x = F.col(x) if isinstance(x, str) else x
    first, last, n = rank_parts(x, by)
    return F.when(x.isNotNull(), (first + last) / 2.0 / n)


def rank_parts(x: Column, by: Sequence[str]) -> tuple[Column, Column, Column]:
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    return (
        F.rank().over(w),
        F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        F.count(x).over(Window.partitionBy(*by)),
    )


def rank_avg(x, by: Sequence[str] = ("date",)) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    first, last, _ = rank_parts(x, by)
    return F.when(x.isNotNull(), (first + last) / 2.0)


#: Rows of one group that a window may hold in a task; larger groups are split.
GROUP_ROWS = 1_000_000
#: Value ranges in an octave, for sums below a range.
OCTAVE = 1024.0


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; only the group's columns are computed for it."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0


def rank_columns(df: DataFrame, ranks: Mapping[str, tuple[str, Sequence[str]]], key: Sequence[str], names: int | None = None) -> DataFrame:
    """Adds ``rank_pct`` columns ``{out: (column, by)}``; ``key`` names a row within its groups.

    ``names`` bounds the rows of a group and is counted if not known. Up to ``GROUP_ROWS`` a group is one window
    and ranks of one grouping share its exchange; beyond it no task sees a group (:func:`rank_split`).
    """
    groupings = list(dict.fromkeys(tuple(by) for _, by in ranks.values()))
    for by in groupings:
        some = {out: x for out, (x, b) in ranks.items() if tuple(b) == by}
        if (largest_group(df, by) if names is None else names) <= GROUP_ROWS:
            df = df.withColumns({out: rank_pct(x, by) for out, x in some.items()})
        else:
            df = rank_split(df, some, by, key)
    return df


def value_range(x: Column) -> Column:
    """Number of a range of values, larger for larger values: 1,024 ranges an octave, cut at fixed places."""
    size = F.floor((F.least(F.log2(F.abs(x)), F.lit(2000.0)) + 1100.0) * OCTAVE).cast("long")
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def rank_split(df: DataFrame, columns: Mapping[str, str], by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The ranks of ``{out: column}`` for groups of any size, all columns in one exchange.

    Equal values of a group and column become one counted row first, so a value that most rows share is one row.
    Fixed value ranges give every range the number of values below it (an offset table), and places inside a
    range come from a window over the range. Ranks return to the rows by value, and to columns by ``key``; the
    rows of a hot value are dealt to several tasks by adaptive execution. Null and NaN-free values only; a null
    has a null rank.
    """
    keys, row = list(by), list(dict.fromkeys([*by, *key]))
    names = list(columns)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(x).cast("double").alias("_v")) for i, x in enumerate(columns.values())]))
    long = df.select(*row, cells.alias("_x")).select(*row, "_x.*").where("_v IS NOT NULL").withColumn("_v", F.col("_v") + 0.0)
    counts = long.groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_b", value_range(F.col("_v")))
    ranges = counts.groupBy(*keys, "_c", "_b").agg(F.sum("_m").alias("_in"))
    w = Window.partitionBy(*keys, "_c")
    offsets = ranges.select(*keys, "_c", "_b", (F.sum("_in").over(w.orderBy("_b")) - F.col("_in")).alias("_below"), F.sum("_in").over(w).alias("_n"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_c", "_b").orderBy("_v"))
    placed = counts.withColumn("_upto", upto).join(offsets, [*keys, "_c", "_b"])
    ranked = placed.select(*keys, "_c", "_v", safe_div(F.col("_below") + F.col("_upto") - (F.col("_m") - 1) / 2.0, F.col("_n")).alias("_r"))
    if len(names) == 1:  # the value leads straight back to the row
        (out, x), = columns.items()
        back = ranked.drop("_c").withColumnRenamed("_r", out)
        return df.withColumn("_v", F.col(x).cast("double") + 0.0).join(back, [*keys, "_v"], "left").select(*df.columns, out)
    picks = [F.max(F.when(F.col("_c") == i, F.col("_r"))).alias(out) for i, out in enumerate(names)]
    wide = long.join(ranked, [*keys, "_c", "_v"]).groupBy(*row).agg(*picks)
    return df.join(wide, row, "left").select(*df.columns, *names)


def quantile_pair(x: str, p: float) -> Column:
    """Lower and upper quantile, linearly interpolated, as one aggregate of an array.

    Exact; the state is the distinct values of a group with their counts, combined before the shuffle.
    """
    return F.percentile(x, F.array(F.lit(p), F.lit(1 - p)))


def quantile_bounds(df: DataFrame, cols: Sequence[str], p: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """The pair of every column per group."""
    return df.groupBy(*by).agg(*[quantile_pair(x, p).alias(f"_q_{x}") for x in cols])


#: Bits of a digit of the radix selection.
DIGIT = 16


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros count as one."""
    bits = (x + 0.0).view(np.uint64)
    top = np.uint64(1) << np.uint64(63)
    return np.where(bits & top, ~bits, bits | top)


def _from_bits(u: int) -> float:
    top = 1 << 63
    return float(np.array([u ^ top if u & top else u ^ ((1 << 64) - 1)], np.uint64).view(np.float64)[0])


def quantile_bounds_split(df: DataFrame, cols: Sequence[str], p: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """The pairs of :func:`quantile_bounds` for groups of any size, by radix selection on the bits of the values.

    Four rounds fix 16 bits each of the four order statistics around the two quantiles. In a round every task
    counts the next digit of the values that share the bits found so far; the histograms of all tasks are summed,
    and the digit that holds the wanted place goes on. A task sends one number per digit it met, a group merges at
    most 65,536 of them per column and statistic, and the bits found so far (four numbers per group and column;
    groups are dates) go back to the tasks. ``df`` is read once a round: pass a written table. NaN is unknown.
    """
    spark, keys, k, width = df.sparkSession, list(by), len(cols), 4 * len(cols)
    types = dict(df.dtypes)
    rows = df.select(*keys, *[F.col(x).cast("double").alias(f"_{i}") for i, x in enumerate(cols)])
    sizes = stored(spark, rows.groupBy(*keys).agg(F.array(*[F.count(F.nanvl(f"_{i}", F.lit(None))) for i in range(k)]).alias("_n")), "radix")
    place = [f(F.lit(q) * F.greatest(F.col("_n")[i] - 1, F.lit(0))).cast("long") for i in range(k) for q in (p, 1 - p) for f in (F.floor, F.ceil)]
    state = sizes.select(*keys, F.array(*[F.lit(0).cast("long")] * width).alias("_bits"), F.array(*place).alias("_place"))
    heads_schema = ", ".join(f"`{x}` {types[x]}" for x in keys)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        found = {tuple(r[x] for x in keys): r["_bits"] for r in state.select(*keys, "_bits").toLocalIterator()}
        shared = spark.sparkContext.broadcast(found)

        def count(batches: Iterator[pa.RecordBatch], shift=shift, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                group = pa.Table.from_arrays(b.columns[:len(keys)], names=keys)
                numbers = group.to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy().astype(np.int64)
                heads = group.take(pa.array(np.unique(numbers, return_index=True)[1]))
                prefix = np.array([shared.value[tuple(r.values())] for r in heads.to_pylist()], np.int64).view(np.uint64)
                for t in range(width):
                    x = b.column(len(keys) + t // 4).to_numpy(zero_copy_only=False)
                    known = np.flatnonzero(~np.isnan(x))
                    u = _ordered_bits(x[known])
                    if shift + DIGIT < 64:
                        same = u >> np.uint64(shift + DIGIT) == prefix[numbers[known], t]
                        known, u = known[same], u[same]
                    digit = (u >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                    code, n = np.unique(numbers[known] << DIGIT | digit, return_counts=True)
                    if len(code):
                        yield pa.RecordBatch.from_arrays(
                            [*[heads.column(x).take(pa.array(code >> DIGIT)).combine_chunks() for x in keys], pa.array(np.full(len(code), t, np.int32)),
                             pa.array((code & ((1 << DIGIT) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))], names=[*keys, "_t", "_d", "_m"])

        histogram = rows.mapInArrow(count, f"{heads_schema}, _t int, _d int, _m long").groupBy(*keys, "_t", "_d").agg(F.sum("_m").alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(*keys, "_t").orderBy("_d"))
        wanted = state.select(*keys, F.posexplode(F.arrays_zip("_bits", "_place")).alias("_t", "_x"))
        hit = histogram.withColumn("_upto", upto).join(wanted, [*keys, "_t"]).where("_upto > _x._place AND _upto - _m <= _x._place")
        one = hit.select(*keys, F.struct("_t", F.struct(F.shiftleft("_x._bits", DIGIT).bitwiseOR(F.col("_d")).alias("bits"),
                                                        (F.col("_x._place") - (F.col("_upto") - F.col("_m"))).alias("place")).alias("f")).alias("_f"))
        packed = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list("_f")).alias("_map"))  # one entry per column and statistic
        every = F.array(*[F.lit(t) for t in range(width)])
        state = stored(spark, sizes.select(*keys).join(packed, keys, "left").select(
            *keys, *[F.transform(every, lambda t: F.coalesce(F.try_element_at("_map", t)[f], F.lit(0).cast("long"))).alias(f"_{f}") for f in ("bits", "place")]), "radix")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(k)]
            for bits, counts in zip(*(b.column(len(keys) + i).to_pylist() for i in (0, 1))):
                for i, n in enumerate(counts):
                    pair = []
                    for j, q in enumerate((p, 1 - p)):
                        low, high = (_from_bits(bits[4 * i + 2 * j + e] % (1 << 64)) for e in (0, 1))
                        at = (n - 1) * q
                        pair.append(low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high)
                    out[i].append(pair if n else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], *[pa.array(o, pa.list_(pa.float64())) for o in out]], names=[*keys, *[f"_q_{x}" for x in cols]])

    return state.join(sizes, keys).select(*keys, "_bits", "_n").mapInArrow(pairs, ", ".join([heads_schema, *[f"`_q_{x}` array<double>" for x in cols]]))
