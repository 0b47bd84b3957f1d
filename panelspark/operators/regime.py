"""Market state from benchmark, macro and cross-market series.

Every function works on ``(date, close)`` rows of one or several series; ``keys`` names the series
columns, so many benchmarks are classified in one job.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bucketize, first_match, safe_div
from ..functions.windows import rolling, rolling_corr

c = F.col

#: exposure per regime
REGIME_EXPOSURE = {
    "bull": 1.0, "recovery": 0.7, "chop": 0.5, "high_vol": 0.3, "bear": 0.2, "crisis": 0.0, "unknown": 0.0,
}
#: exposure multiplier per timer state
STATE_MULT = {"risk_on": 1.0, "neutral": 0.6, "risk_off": 0.3}


def lookup(values: dict, key: Column, default: float = 0.0) -> Column:
    return first_match([(key == k, v) for k, v in values.items()], default)


def _spec(keys: Sequence[str]):
    # a series is one row per trading day: without keys the single partition holds the calendar
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("date")


def inclusive_pct(win: str, x: str, n: int) -> Column:
    """Share of the collected window at or below x, null until n values are there."""
    at_or_below = F.size(F.filter(win, lambda y: y <= c(x)))
    return F.when(F.size(win) == n, at_or_below / F.lit(float(n)))


def _with_vol_pct(bench: DataFrame, w, vol_window: int, vol_lookback: int) -> DataFrame:
    df = bench.withColumn("_r1", safe_div(c("close"), F.lag("close").over(w)) - 1)
    df = df.withColumn("_rv", rolling(F.stddev_samp, "_r1", vol_window, w=w))
    df = df.withColumn("_win", F.collect_list("_rv").over(w.rowsBetween(-(vol_lookback - 1), 0)))
    return df.withColumn("vol_pct", inclusive_pct("_win", "_rv", vol_lookback)).drop("_win")


def classify_regime(bench: DataFrame, trend_window: int = 200, vol_window: int = 20, vol_lookback: int = 252,
                    keys: Sequence[str] = ()) -> DataFrame:
    """bull, vol percentile, vol tercile and risk_on; comparisons in warm-up are false, not unknown."""
    w = _spec(keys)
    df = _with_vol_pct(bench, w, vol_window, vol_lookback)
    df = df.withColumn("_ma", rolling(F.avg, "close", trend_window, w=w))
    bull = F.coalesce(c("close") > c("_ma"), F.lit(False))
    state = bucketize("vol_pct", [-0.01, 1 / 3, 2 / 3, 1.01])
    calm = F.coalesce(state < 2, F.lit(False))
    return df.select(
        *keys, "date", bull.cast("double").alias("bull"), "vol_pct", state.alias("vol_state"),
        (bull & calm).cast("double").alias("risk_on"),
    )


def regime_label(bull="bull", vol_state="vol_state") -> Column:
    vol = first_match([(c(vol_state) == i, n) for i, n in enumerate(("calm", "normal", "stressed"))], None)
    return F.when(c(vol_state).isNull(), "unknown").otherwise(
        F.concat(F.when(c(bull) >= 0.5, "bull").otherwise("bear"), F.lit("-"), vol))


def classify_regime_6(bench: DataFrame, trend_window: int = 200, vol_window: int = 20, vol_lookback: int = 252,
                      dd_window: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    w = _spec(keys)
    df = _with_vol_pct(bench, w, vol_window, vol_lookback)
    df = df.withColumns({
        "_ma": rolling(F.avg, "close", trend_window, w=w),
        "_dd": safe_div(c("close"), rolling(F.max, "close", dd_window, w=w)) - 1,
        "_mom": safe_div(c("close"), F.lag("close", 60).over(w)) - 1,
    }).withColumn("_slope", c("_ma") - F.lag("_ma", 20).over(w))
    above = F.coalesce(c("close") > c("_ma"), F.lit(False))
    rules = [
        (c("_ma").isNull() | c("vol_pct").isNull(), "unknown"),
        ((c("_dd") <= -0.15) & (c("vol_pct") >= 0.80), "crisis"),
        (c("vol_pct") >= 0.80, "high_vol"),
        (above & (c("_slope") > 0) & (c("vol_pct") < 0.66), "bull"),
        (~above & (c("_mom") > 0) & (c("_dd") > -0.15), "recovery"),
        (~above & (c("_slope") < 0), "bear"),
    ]
    out = df.withColumn("regime", first_match(rules, "chop"))
    return out.select(*keys, "date", "regime", lookup(REGIME_EXPOSURE, c("regime")).alias("exposure"))


def vrp_state(df: DataFrame, rv_window: int = 21, lookback: int = 252) -> DataFrame:
    """``df(date, vix, close)``: implied minus realised volatility, its percentile, state and multiplier.

    The whole history, not only the last date; rows without a full look-back are left out.
    """
    w = _spec(())
    out = df.withColumn("_r1", safe_div(c("close"), F.lag("close").over(w)) - 1)
    out = out.withColumn("realized_vol", rolling(F.stddev_samp, "_r1", rv_window, w=w) * math.sqrt(252) * 100)
    out = out.withColumn("vrp", c("vix") - c("realized_vol")).where("vrp IS NOT NULL")
    out = out.withColumn("_win", F.collect_list("vrp").over(w.rowsBetween(-(lookback - 1), 0)))
    out = out.withColumn("vrp_pct", inclusive_pct("_win", "vrp", lookback)).where("vrp_pct IS NOT NULL")
    state = first_match([(c("vrp_pct") >= 0.50, "risk_on"), (c("vrp_pct") >= 0.25, "neutral")], "risk_off")
    out = out.withColumn("state", state)
    return out.select("date", "vix", "realized_vol", "vrp", "vrp_pct", "state", lookup(STATE_MULT, c("state")).alias("mult"))


def macro_risk_off(curve="T10Y2Y", conditions="NFCI") -> Column:
    """Inverted curve or tight conditions; unknown counts as no."""
    return F.coalesce(c(curve) < 0, F.lit(False)) | F.coalesce(c(conditions) > 0, F.lit(False))


def gated_returns(df: DataFrame, ret: str, exposure: str, keys: Sequence[str] = ()) -> DataFrame:
    """Yesterday's exposure earns today's return."""
    w = _spec(keys)
    return df.withColumn("gated", c(ret) * F.coalesce(F.lag(exposure).over(w), F.lit(0.0))).where("gated IS NOT NULL")


def regime_votes(df: DataFrame) -> DataFrame:
    """Four cross-market votes, their mean and the state.

    ``df(date, stock, bond, high_yield, grade, vix, vix3m, breadth)``; a vote whose data is missing is
    absent and does not count. ``breadth`` is the share of names
    with 200 closes that are above their own 200-row mean (null, and so no vote, while there is none).
    """
    w = _spec(())
    out = df.withColumns({
        "_q": safe_div(c("high_yield"), c("grade")),
        "_rs": safe_div(c("stock"), F.lag("stock").over(w)) - 1,
        "_rb": safe_div(c("bond"), F.lag("bond").over(w)) - 1,
    })
    out = out.withColumns({
        "_n": F.count("_q").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_q49": F.lag("_q", 49).over(w),
        "_both": F.count(F.when(c("_rs").isNotNull() & c("_rb").isNotNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_corr": rolling_corr(c("_rs"), c("_rb"), 63, w),
    })
    vote = lambda cond: F.when(cond, 1.0).when(~cond, -1.0)
    votes = {
        "vix_term": F.when(c("vix") > 0, vote(safe_div(c("vix3m"), c("vix")) >= 1.0)),
        "credit": F.when(c("_n") > 55, vote(c("_q") > c("_q49"))),
        "breadth_vote": vote(c("breadth") >= 0.5),
        "stock_bond_corr": F.when(c("_both") > 63, -vote(c("_corr") > 0.3)),
    }
    out = out.withColumns(votes)
    present = F.map_filter(
        F.create_map(*[x for k in votes for x in (F.lit(k), c(k))]), lambda _, v: v.isNotNull())
    out = out.withColumn("votes", present).where(F.size("votes") > 0)
    score = F.aggregate(F.map_values("votes"), F.lit(0.0), lambda a, v: a + v) / F.size("votes")
    out = out.withColumn("score", score)
    state = first_match([(c("score") >= 0.25, "risk_on"), (c("score") <= -0.25, "risk_off")], "neutral")
    out = out.withColumn("state", state)
    return out.select("date", *votes, "votes", "score", "state", lookup(STATE_MULT, c("state")).alias("mult"))
