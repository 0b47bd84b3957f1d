"""Purged, embargoed walk-forward folds and leakage audit.

Folds are positions on the trading calendar. Whatever is asked of a fold is aggregated per date first,
so the fold logic works on a few thousand rows however large the panel is.
"""
from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.bars import calendar
from .evaluate import feature_target_corr

c = F.col


def date_positions(panel: DataFrame) -> DataFrame:
    return calendar(panel)


def walk_forward_folds(positions: DataFrame, n_splits: int, train_min: int, test: int, embargo: int, horizon: int) -> DataFrame:
    """``(fold, train_lo, train_hi, test_lo, test_hi)``, half-open, numbered in time order.

    Laid out from the end backwards; a fold whose training window would be shorter than ``train_min``
    ends the list. The embargo is at least the label horizon.
    """
    embargo = max(embargo, horizon)
    n = positions.agg((F.max("pos") + 1).alias("n"))
    back = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("i"))
    fold = back.select(
        c("i"),
        F.lit(0).cast("long").alias("train_lo"),
        (c("n") - c("i") * test - embargo - horizon).alias("train_hi"),
        (c("n") - c("i") * test).alias("test_lo"),
        (c("n") - (c("i") - 1) * test).alias("test_hi"),
    ).where(c("train_hi") >= train_min)
    kept = fold.agg(F.max("i")).scalar()
    return fold.select((kept - c("i")).cast("long").alias("fold"), "train_lo", "train_hi", "test_lo", "test_hi")


def fold_sides(df: DataFrame, folds: DataFrame, horizon: int, purge: bool = True) -> DataFrame:
    """Rows with a position, once per fold they serve, flagged ``in_train`` / ``in_test``.

    ``folds`` has at most ``n_splits`` rows, so its broadcast does not grow with the data. A training row
    whose label reaches into the test window is purged.
    """
    test = (c("pos") >= c("test_lo")) & (c("pos") < c("test_hi"))
    train = (c("pos") >= c("train_lo")) & (c("pos") < c("train_hi"))
    if purge:
        train = train & ((c("pos") + horizon < c("test_lo")) | (c("pos") >= c("test_lo")))
    return df.join(F.broadcast(folds), train | test).withColumns({"in_train": train, "in_test": test}).drop(
        "train_lo", "train_hi", "test_lo", "test_hi")


def in_fold(panel: DataFrame, folds: DataFrame, horizon: int, purge: bool = True) -> DataFrame:
    """Panel rows per fold with ``role`` train or test."""
    sides = fold_sides(panel, folds, horizon, purge)
    roles = F.array_compact(F.array(F.when(c("in_train"), "train"), F.when(c("in_test"), "test")))
    return sides.withColumn("role", F.explode(roles)).drop("in_train", "in_test")


def fold_stats(panel: DataFrame, folds: DataFrame, horizon: int, purge: bool = True) -> DataFrame:
    """Rows and date range of both sides of each fold, from counts per date."""
    per_date = panel.groupBy("date", "pos").agg(F.count(F.lit(1)).alias("_n"))
    side = fold_sides(per_date, folds, horizon, purge)
    train, test = c("in_train"), c("in_test")
    return side.groupBy("fold").agg(
        F.min(F.when(train, c("date"))).alias("train_from"), F.max(F.when(train, c("date"))).alias("train_to"),
        F.min(F.when(test, c("date"))).alias("test_from"), F.max(F.when(test, c("date"))).alias("test_to"),
        F.sum(F.when(train, c("_n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(test, c("_n")).otherwise(0)).alias("n_test"),
    )


def train_test_overlap(panel: DataFrame, folds: DataFrame, horizon: int, purge: bool = True) -> DataFrame:
    """Dates that are on both sides of a fold; must be empty.

    All rows of a date fall on the same side, so dates tell as much as rows.
    """
    sides = fold_sides(panel.select("date", "pos").distinct(), folds, horizon, purge)
    return sides.where("in_train").select("fold", "date").intersect(sides.where("in_test").select("fold", "date"))


def leakage_audit(panel: DataFrame, folds: DataFrame, features: Sequence[str], horizon: int, purge: bool = True) -> DataFrame:
    """Issues ``(kind, subject, value)``; empty when the panel and folds are clean."""
    contaminated = feature_target_corr(panel, features).where("leak").select(
        F.lit("feature_is_target").alias("kind"), c("feature").alias("subject"), c("corr").alias("value"))
    stats = fold_stats(panel, folds, horizon, purge)
    gap = F.datediff("test_from", "train_to")
    order = stats.where(gap < 1).select(
        F.lit("train_not_before_test").alias("kind"), c("fold").cast("string").alias("subject"), gap.cast("double").alias("value"))
    overlap = train_test_overlap(panel, folds, horizon, purge).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("train_test_overlap").alias("kind"), c("fold").cast("string").alias("subject"), c("n").cast("double").alias("value"))
    return contaminated.unionByName(order).unionByName(overlap)


def perturb_future(bars: DataFrame, cut_pos: int, factor: float = 1.5) -> DataFrame:
    """Bars whose prices and volumes after a calendar position are changed."""
    late = c("pos") > cut_pos
    cols = [x for x in ("open", "high", "low", "close", "volume") if x in bars.columns]
    return bars.withColumns({x: F.when(late, c(x) * (factor + F.pmod("pos", F.lit(7)) / 10.0)).otherwise(c(x)) for x in cols})


def lookahead_probe(bars: DataFrame, feature: Callable[[DataFrame], DataFrame], cut_pos: int, block: int = 64) -> DataFrame:
    """Features of rows at or before the cut that change when only later bars change: ``(feature, n_tickers, first_pos)``.

    ``feature`` gives ``(date, pos, ticker, features...)``. Both runs are computed and written once for all features and meet
    as digests: the exclusive or of row hashes per ticker, block of positions and feature, in which equal rows
    cancel. Only what is left over is opened: the first leaking block of each feature, row by row. Empty when
    nothing looks ahead.
    """
    both = feature(bars).where(c("pos") <= cut_pos).unionByName(feature(perturb_future(bars, cut_pos)).where(c("pos") <= cut_pos))
    features = [x for x in both.columns if x not in ("date", "pos", "ticker")]
    both = stored(bars.sparkSession, both.withColumn("_block", F.floor(c("pos") / block).cast("long")), "probe")

    def digests(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
        sums = [F.bit_xor(F.xxhash64("ticker", "pos", x)).alias(x) for x in names]
        leaves = rows.groupBy(*keys).agg(*sums)
        return leaves.unpivot(list(keys), list(names), "feature", "_digest").where("_digest <> 0").drop("_digest")

    leaks = stored(bars.sparkSession, digests(both, ["ticker", "_block"], features), "leaks")
    found = leaks.groupBy("feature").agg(F.countDistinct("ticker").alias("n_tickers"), F.min("_block").alias("_block"))
    named = [r.feature for r in found.select("feature").collect()]  # at most the features
    if not named:
        return found.select("feature", "n_tickers", F.lit(None).cast("long").alias("first_pos"))
    opened = both.join(F.broadcast(found.select("_block").distinct()), "_block")  # at most one row a feature
    rows = digests(opened, ["ticker", "pos"], named).groupBy("feature").agg(F.min("pos").cast("long").alias("first_pos"))
    return found.join(rows, "feature").select("feature", "n_tickers", "first_pos")
