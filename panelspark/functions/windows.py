"""Window building blocks on a long panel.

A panel holds one row per ``(date, ticker)``, so a window by ticker is bounded by the length of the
trading calendar and tasks spread over tickers. Features are lists of *levels*: a level is a dict of
named expressions that may use the columns of the levels before it. ``add_features`` evaluates level
by level, so all features that share the ordering share one exchange and one sort.
"""
from __future__ import annotations

import math
from typing import Callable, Dict, List, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import safe_div

Levels = List[Dict[str, Column]]

def ordered(keys: Sequence[str] = ("ticker",), order: Sequence[str] = ("date",)):
    return Window.partitionBy(*keys).orderBy(*order)


def series():
    """A ticker's history in date order."""
    return ordered()


def so_far():
    """From a ticker's first row to the current one."""
    return series().rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Callable[[Column], Column], x, n: int, min_periods: int | None = None, w=None) -> Column:
    """``agg`` over the last ``n`` rows, null until ``min_periods`` (default ``n``) non-null values."""
    x = F.col(x) if isinstance(x, str) else x
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods), agg(x).over(frame))


def rolling_corr(x, y, n: int, w=None) -> Column:
    """Pearson correlation of two columns over the last ``n`` complete rows of the frame."""
    frame = (w or series()).rowsBetween(-(n - 1), 0)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(
        F.count(a).over(frame) >= n,
        safe_div(F.covar_pop(a, b).over(frame), F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)),
    )


def merge_levels(*features: Levels) -> Levels:
    out: Levels = []
    for feature in features:
        for i, level in enumerate(feature):
            if i == len(out):
                out.append({})
            out[i].update(level)
    return out


def delay(levels: Levels, by: int) -> Levels:
    """Shift a feature ``by`` levels down so it can use what earlier levels produce."""
    return [{} for _ in range(by)] + levels


def add_features(df: DataFrame, features: Sequence[Levels], keep: Sequence[str] | None = None) -> DataFrame:
    """Evaluate features; helper columns start with an underscore and are dropped at the end."""
    before = set(df.columns)
    for level in merge_levels(*features):
        if level:
            df = df.withColumns(level)
    added = keep or [c for c in df.columns if not c.startswith("_")]
    return df.select(*[c for c in df.columns if c in before], *[c for c in added if c not in before])


def ewm_levels(name: str, x: Column, alpha: float, tag: str, keys: Sequence[str] = ("ticker",)) -> Levels:
    """Recursive exponential mean ``y = (1-a) y' + a x`` seeded with the first non-null value.

    Closed form over blocks of rows: inside a block a running sum of ``a x q^-j`` scaled by ``q^i``;
    across blocks the sums of all earlier blocks, each decayed by the values between. A block's length
    keeps the powers inside the double range, there are few blocks, and no row leaves the window operator,
    so a history of any length works, however sparse. Seven levels, result in the last.
    """
    rate = -math.log1p(-alpha)
    rows = 5600 if 50 <= rate * 5600 <= 600 else max(1, int(600 / rate))
    blk, end, v, n, base, term, run, older = (
        f"_blk{rows}", f"_end{rows}", f"_{tag}_x", f"_{tag}_n", f"_{tag}_b", f"_{tag}_t", f"_{tag}_s", f"_{tag}_o",
    )
    by = ordered(keys)
    cum = ordered([*keys, blk]).rowsBetween(Window.unboundedPreceding, 0)
    earlier = ordered(keys, [blk]).rangeBetween(Window.unboundedPreceding, -1)
    c = F.col
    since_base = (c(n) - c(base)).cast("double") * rate
    at = F.row_number().over(by)
    # decay counts values, so a block without any passes on what came before it unchanged
    carried = F.aggregate(older, F.lit(0.0), lambda acc, o: acc + o["s"] * F.exp((o["b"] - c(base)).cast("double") * rate))
    return [
        {v: x, blk: F.floor((at - 1) / rows).cast("long"), end: at % rows == 0},
        {n: F.count(c(v)).over(by.rowsBetween(Window.unboundedPreceding, 0))},
        {base: F.first(c(n)).over(cum)},
        {term: F.when(c(n) == 1, 1.0).otherwise(alpha) * c(v) * F.exp(since_base)},
        {run: F.coalesce(F.sum(c(term)).over(cum), F.lit(0.0))},
        {older: F.collect_list(F.when(c(end), F.struct(c(run).alias("s"), c(base).alias("b")))).over(earlier)},
        {name: F.when(c(n) > 0, F.exp(-since_base) * (c(run) + carried))},
    ]


def gain_recurrence_levels(name: str, x: Column, gain: Column, tag: str, keys: Sequence[str] = ("ticker",)) -> Levels:
    """``y = y' + g (x - y')`` with a gain ``0 <= g < 1`` that changes by row, seeded with the first x.

    Same closed form as :func:`ewm_levels`, but blocks are cut by accumulated decay instead of rows.
    """
    span = 300.0
    v, g, acc, blk, inside, term, run, prev, first = (f"_{tag}_{s}" for s in ("x", "g", "l", "k", "m", "t", "s", "p", "r"))
    by = ordered(keys)
    c = F.col
    cum = ordered([*keys, blk]).rowsBetween(Window.unboundedPreceding, 0)
    previous = ordered(keys, [blk]).rangeBetween(-1, -1)
    return [
        {first: F.row_number().over(by)},
        {v: x, g: gain, acc: F.sum(F.when(c(first) > 1, -F.log1p(-gain)).otherwise(0.0)).over(
            by.rowsBetween(Window.unboundedPreceding, 0))},
        {blk: F.floor(c(acc) / span).cast("long"), inside: c(acc) - F.floor(c(acc) / span) * span},
        {term: F.when(c(first) == 1, 1.0).otherwise(c(g)) * c(v) * F.exp(c(inside))},
        {run: F.sum(c(term)).over(cum), prev: F.sum(c(term)).over(previous)},
        {
            name: F.exp(-c(inside))
            * (c(run) + F.coalesce(c(prev) * math.exp(-span), F.lit(0.0)))
        },
    ]
