"""Ledger statistics: standings, rollups, rolling performance, drift and decay alarms."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from .joins import asof_lookup

c = F.col
ROOT = math.sqrt(252)
MIN_OBS, PH_DELTA, PH_LAMBDA = 20, 0.0005, 0.05


def _sharpe(sd, mean):
    return F.when(sd > 0, mean / sd * ROOT)


def standings(ledger: DataFrame) -> DataFrame:
    """Scoreboard per sleeve; zero returns count in the win rate. All aggregates combine map-side."""
    r = c("day_return")
    exposure = F.aggregate(F.col("_l.decisions"), F.lit(0.0), lambda a, x: a + F.coalesce(x["target_weight"], F.lit(0.0)))
    agg = ledger.groupBy("sleeve").agg(
        F.count(r).alias("n_days"), (F.coalesce(F.product(1 + r), F.lit(1.0)) - 1).alias("cum_return"),
        F.stddev_samp(r).alias("_sd"), F.avg(r).alias("_m"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.max_by(F.struct("date", "n_positions", "decisions"), "date").alias("_l"))
    return agg.select(
        "sleeve", "n_days", "cum_return", _sharpe(c("_sd"), c("_m")).alias("sharpe"), "best_day", "worst_day", "win_rate",
        c("_l.date").alias("last_date"), exposure.alias("last_exposure"), c("_l.n_positions").cast("long").alias("last_positions"))


def period_rollup(ledger: DataFrame, freq: str = "week") -> DataFrame:
    """Compounded return per (period start, sleeve); weeks run Monday to Sunday."""
    return ledger.where("day_return IS NOT NULL").groupBy(
        F.date_trunc(freq, "date").cast("date").alias("period"), "sleeve").agg(
        (F.product(1 + c("day_return")) - 1).alias("ret"))


def rolling_performance(ledger: DataFrame, window: int = 63) -> DataFrame:
    """Last ``window`` realised rows of every sleeve."""
    w = Window.partitionBy("sleeve").orderBy(c("date").desc())
    r = c("day_return")
    tail = ledger.where("day_return IS NOT NULL").withColumn("_k", F.row_number().over(w)).where(c("_k") <= window)
    return tail.groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("n_days"), (F.product(1 + r) - 1).alias("cum_return"),
        _sharpe(F.stddev_samp(r), F.avg(r)).alias("sharpe"), F.min(r).alias("max_day_loss"),
        F.avg((r > 0).cast("double")).alias("win_rate"))


def tail_per_key(df: DataFrame, n: int, key: str = "sleeve", order: str = "date") -> DataFrame:
    w = Window.partitionBy(key).orderBy(c(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where(c("_k") <= n).drop("_k")


def sharpe_lcb(ledger: DataFrame) -> DataFrame:
    """Annual Sharpe and its lower bound S - 1.64 sqrt((1 + S^2 / 2) / n)."""
    r = c("day_return")
    agg = ledger.where("day_return IS NOT NULL").groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_sd"))
    s = F.when((c("n") >= 2) & (c("_sd") > 0), c("_m") / c("_sd"))
    return agg.select("sleeve", "n", (s * ROOT).alias("sharpe"),
                      ((s - 1.64 * F.sqrt((1 + 0.5 * s * s) / c("n"))) * ROOT).alias("sharpe_lcb"))


def page_hinkley(ledger: DataFrame, delta: float = PH_DELTA, lam: float = PH_LAMBDA) -> DataFrame:
    """Two-sided change alarm per row: running mean, two cumulative sums, their extremes; three stacked
    windows with one sort. ``alarm`` is whether any row so far exceeded the threshold."""
    w = Window.partitionBy("sleeve").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = ledger.where("day_return IS NOT NULL").withColumn("_mean", F.avg("day_return").over(w))
    df = df.withColumns({
        "_up": F.sum(c("day_return") - c("_mean") - delta).over(w),
        "_dn": F.sum(c("day_return") - c("_mean") + delta).over(w),
    })
    df = df.withColumns({"rise": c("_up") - F.min("_up").over(w), "fall": F.max("_dn").over(w) - c("_dn")})
    df = df.withColumn("alarm", F.max((c("rise") > lam) | (c("fall") > lam)).over(w))
    return df.select("sleeve", "date", "rise", "fall", "alarm")


def drift_report(ledger: DataFrame) -> DataFrame:
    """Health of every sleeve; under 20 observations it is warming up and raises nothing."""
    alarms = page_hinkley(ledger).groupBy("sleeve").agg(F.max("alarm").alias("_a"))
    x = sharpe_lcb(ledger).join(alarms, "sleeve")
    warm = c("n") >= MIN_OBS
    decay = warm & F.coalesce(c("sharpe_lcb") <= 0, F.lit(False))
    drift = warm & c("_a")
    notes = F.concat_ws("; ", F.when(decay, "edge decay"), F.when(drift, "change point"))
    return x.select(
        "sleeve", "n", F.when(warm, c("sharpe")).alias("sharpe"), F.when(warm, c("sharpe_lcb")).alias("sharpe_lcb"),
        decay.alias("decay_flag"), drift.alias("drift_flag"),
        F.when(~warm, F.concat(F.lit("warming up ("), c("n").cast("string"), F.lit("/20 obs)")))
        .when(notes == "", "ok").otherwise(notes).alias("note"))


def realized_gap_return(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Return of each book between two dates: ``targets(sleeve, ticker, weight, d0, d1)``.

    Unknown assets are ignored, cash earns 0, an empty gap returns 0.
    """
    a = asof_lookup(prices, targets.select("sleeve", "ticker", "weight", "d0", "d1")
                    .withColumn("point_date", c("d0"))).withColumnRenamed("price", "_p0").drop("point_date")
    b = asof_lookup(prices, a.withColumn("point_date", c("d1"))).withColumnRenamed("price", "_p1")
    gain = F.when((c("d0") < c("d1")) & (c("_p0") > 0), c("weight") * (safe_div(c("_p1"), c("_p0")) - 1))
    return b.groupBy("sleeve").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("day_return"))
