"""Weights, turnover, costs and returns of many strategies at once.

Tables are keyed by ``strategy``; scale comes from strategies and dates. Path-dependent overlays are in
:mod:`governance`.
"""
from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div, turnover_cost
from ..functions.windows import series
from .joins import weight_delta_join

c = F.col
BOOK = ("strategy", "date")


def every_nth(dates: DataFrame, k: int) -> DataFrame:
    """Rebalance calendar: every k-th date from the first, numbered."""
    from ..sources.bars import calendar
    return calendar(dates).where(F.pmod("pos", F.lit(k)) == 0).select(
        "date", F.floor(c("pos") / k).cast("long").alias("rebal_no"))


def daily_returns(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(series())
    return bars.select("date", "pos", "ticker", (safe_div(c("close"), prev) - 1).alias("r"))


# --- weighting schemes -------------------------------------------------------------------------------------


def cap_and_normalize(weights: DataFrame, cap: float, by: Sequence[str] = BOOK, rounds: int = 10, strict: bool = False) -> DataFrame:
    """Clip at 0, normalise, move what exceeds the cap to the others pro rata, normalise.

    With k * cap < 1 the last step exceeds the cap again; ``strict`` leaves the rest in cash instead.
    A group is one book on one date: its names, not its history.
    """
    w = Window.partitionBy(*by)
    n, s = F.count(F.lit(1)).over(w), F.sum(F.greatest("weight", F.lit(0.0))).over(w)
    df = weights.withColumn("_w", F.when(s > 0, F.greatest("weight", F.lit(0.0)) / s).otherwise(1.0 / n))
    for _ in range(rounds):
        over = c("_w") > cap
        df = df.withColumns({
            "_ex": F.sum(F.when(over, c("_w") - cap).otherwise(0.0)).over(w),
            "_un": F.sum(F.when(~over, c("_w")).otherwise(0.0)).over(w),
        }).withColumn("_w", F.when(over, cap).otherwise(c("_w") + F.coalesce(safe_div(c("_ex") * c("_w"), c("_un")), F.lit(0.0))))
    final = F.least("_w", F.lit(cap)) if strict else c("_w") / F.sum("_w").over(w)
    # an all-zero book takes equal weights as they are
    return df.withColumn("_z", s > 0).withColumn(
        "weight", F.when(c("_z"), final).otherwise(c("_w"))).drop("_w", "_ex", "_un", "_z")


def equal_weight(picks: DataFrame, cap: float, by: Sequence[str] = BOOK) -> DataFrame:
    return cap_and_normalize(picks.withColumn("weight", F.lit(1.0)), cap, by)


def lookback_returns(picks: DataFrame, returns: DataFrame, n: int = 60) -> DataFrame:
    """Last n daily returns of every pick, complete cases only: days on which all picks of the book have
    a return. ``picks(strategy, date, pos, ticker)``."""
    days = picks.select("strategy", "date", "ticker", F.explode(F.sequence(F.greatest(c("pos") - (n - 1), F.lit(0)), c("pos"))).alias("pos"))
    hist = days.join(returns.where("r IS NOT NULL").select("ticker", "pos", "r"), ["ticker", "pos"])
    book = Window.partitionBy("strategy", "date")
    names, have = F.size(F.collect_set("ticker").over(book)), F.count(F.lit(1)).over(Window.partitionBy("strategy", "date", "pos"))
    return hist.withColumns({"_k": names, "_have": have}).where("_have = _k").drop("_k", "_have")


def inverse_vol(picks: DataFrame, returns: DataFrame, cap: float, n: int = 60) -> DataFrame:
    """1 / volatility over complete cases; a name without usable volatility takes the mean of the others."""
    vol = lookback_returns(picks, returns, n).groupBy("strategy", "date", "ticker").agg(F.stddev_samp("r").alias("_v"))
    w = Window.partitionBy("strategy", "date")
    inv = vol.withColumn("_i", safe_div(F.lit(1.0), c("_v")))
    return cap_and_normalize(inv.select(
        "strategy", "date", "ticker", F.coalesce("_i", F.avg("_i").over(w)).alias("weight")), cap)


def _risk_parity_weights(returns: np.ndarray) -> np.ndarray:
    """Weights w with equal w_i (S w)_i: the minimum of w'Sw/2 - mean(log w), one coordinate at a time.

    In each coordinate that is a quadratic equation with one positive root; the function is convex, so a
    solution exists for hedges too. A name without variance takes the least variance of the others.
    """
    cov = np.atleast_2d(np.cov(returns, rowvar=False, ddof=1))
    n, own = len(cov), np.diag(cov).copy()
    own[own <= 0] = own[own > 0].min() if (own > 0).any() else 1.0
    w = 1.0 / np.sqrt(own)
    w /= np.sqrt(max(w @ cov @ w, 1e-300)) if (np.diag(cov) > 0).any() else 1.0
    for _ in range(10_000):
        before = w.copy()
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest * rest + 4 * own[i] / n)) / (2 * own[i])
        if np.abs(w - before).max() <= 1e-12 * w.max():
            return w / w.sum()
    raise ArithmeticError("risk parity has not converged")


def risk_parity(picks: DataFrame, returns: DataFrame, cap: float, n: int = 60) -> DataFrame:
    """Equal risk contribution: one small iterative solve per book and rebalance date, spread over tasks.

    A group holds n days of the picked names of one book.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="pos", columns="ticker", values="r")
        w = _risk_parity_weights(wide.to_numpy())
        return pd.DataFrame({"strategy": pdf["strategy"].iloc[0], "date": pdf["date"].iloc[0], "ticker": wide.columns, "weight": w})

    hist = lookback_returns(picks, returns, n).select("strategy", "date", "pos", "ticker", "r")
    raw = hist.groupBy("strategy", "date").applyInPandas(solve, "strategy string, date date, ticker string, weight double")
    return cap_and_normalize(raw, cap)


# --- turnover and returns -------------------------------------------------------------------------------------


def turnover(weights: DataFrame) -> DataFrame:
    """Sum of absolute weight changes per rebalance; the first one buys from cash."""
    return weight_delta_join(weights).groupBy("strategy", "rebal_no").agg(
        F.sum(F.abs(c("new_w") - c("old_w"))).alias("turnover"))


def average_turnover(weights: DataFrame) -> DataFrame:
    return turnover(weights).groupBy("strategy").agg(
        F.avg("turnover").alias("avg_turnover"), F.count(F.lit(1)).alias("n_rebalances"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, calendar: DataFrame, commission_bps: float = 1.0,
                      slippage_bps: float = 4.0) -> DataFrame:
    """Yesterday's weights earn today's return; the cost falls on the rebalance day.

    ``weights(strategy, rebal_no, date, pos, ticker, weight)``. A book is held from the day after its
    rebalance through the next rebalance day: each row repeats over its holding days, so the join on
    ``(ticker, pos)`` is an equality. Works for long-only and long-short weights alike.
    """
    books = weights.select("strategy", "rebal_no", "date", "pos").distinct()
    w = Window.partitionBy("strategy").orderBy("rebal_no")
    last = calendar.agg(F.max("pos")).scalar()
    spans = books.withColumn("_to", F.coalesce(F.lead("pos").over(w), last))
    held = (
        weights.join(spans.select("strategy", "rebal_no", "_to"), ["strategy", "rebal_no"])
        .where("_to > pos")
        .select("strategy", "ticker", "weight", F.explode(F.sequence(c("pos") + 1, c("_to"))).alias("pos"))
    )
    gross = held.join(returns.select("ticker", "pos", "r"), ["ticker", "pos"], "left").groupBy("strategy", "pos").agg(
        F.sum(c("weight") * F.coalesce("r", F.lit(0.0))).alias("gross"))
    cost = turnover(weights).join(books, ["strategy", "rebal_no"]).select(
        "strategy", "pos", turnover_cost("turnover", commission_bps, slippage_bps).alias("cost"))
    both = gross.join(cost, ["strategy", "pos"], "full_outer")
    net = F.coalesce("gross", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0))
    return both.join(calendar, "pos").select("strategy", "date", "pos", F.coalesce("gross", F.lit(0.0)).alias("gross"),
                                             F.coalesce("cost", F.lit(0.0)).alias("cost"), net.alias("ret"))


def buy_and_hold(bars: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Return series of benchmark tickers; the first day earns 0."""
    from .evaluate import nav_drawdown
    held = daily_returns(bars.where(c("ticker").isin(*tickers)))
    rets = held.select(c("ticker").alias("strategy"), "date", F.coalesce("r", F.lit(0.0)).alias("ret"))
    return nav_drawdown(rets).select("strategy", "date", "ret", "nav")


def dca_schedule(returns: DataFrame, mode: str = "dca", initial: float = 1.0, amount: float = 0.1, every: int = 10) -> DataFrame:
    """Money-weighted account with contributions every ``every`` rows.

    equity_t = nav_t * (initial + sum of c_s / nav_s for s <= t), so no step-by-step account is needed.
    ``variable`` scales the contribution by 0.5 to 2 against the last 20 rows' return. Several return
    columns named ``ret_*`` share the schedule of ``ret``.
    """
    w = Window.partitionBy("strategy").orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    accounts = [x for x in returns.columns if x == "ret" or x.startswith("ret_")]
    df = returns.withColumns({
        "_i": F.row_number().over(w) - 1,
        "_recent": F.product(1 + c("ret")).over(w.rowsBetween(-19, 0)) - 1,
        **{f"_nav_{a}": F.product(1 + c(a)).over(so_far) for a in accounts},
    })
    due = (c("_i") > 0) & (F.pmod("_i", F.lit(every)) == 0)
    tilt = F.greatest(F.least(1.0 - 5 * c("_recent"), F.lit(2.0)), F.lit(0.5)) if mode == "variable" else F.lit(1.0)
    pay = F.when(due, amount * tilt).otherwise(0.0) if mode != "none" else F.lit(0.0)
    df = df.withColumn("contribution", pay)
    eq = {f"equity{a[3:]}": c(f"_nav_{a}") * (initial + F.sum(safe_div(c("contribution"), c(f"_nav_{a}"))).over(so_far)) for a in accounts}
    return df.withColumns(eq).select("strategy", "date", "contribution", *eq)


# --- books and allocation -----------------------------------------------------------------------------------------


def microcap_caps(weights: DataFrame, is_micro: Column, max_agg: float = 0.10, max_pos: float = 0.01,
                  by: Sequence[str] = BOOK) -> DataFrame:
    """Cap each microcap, then their sum."""
    df = weights.withColumn("_m", is_micro).withColumn(
        "weight", F.when(c("_m"), F.least("weight", F.lit(max_pos))).otherwise(c("weight")))
    agg = F.sum(F.when(c("_m"), c("weight"))).over(Window.partitionBy(*by))
    scale = F.when(c("_m") & (agg > max_agg), max_agg / agg).otherwise(1.0)
    return df.withColumn("weight", c("weight") * scale).drop("_m")


def rescale_book(weights: DataFrame, cap: Column | float, by: Sequence[str] = BOOK) -> DataFrame:
    """Scale a book down to its cap; a book under the cap stays."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    total = F.sum("weight").over(Window.partitionBy(*by))
    return weights.withColumn("weight", c("weight") * F.when((total > cap) & (total > 0), cap / total).otherwise(1.0))


EXPERIMENTAL_CAP = 0.05


def combine_sleeves(targets: DataFrame, sleeves: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """One portfolio out of the live sleeves.

    ``targets(by, sleeve, ticker, weight)``; ``sleeves(sleeve, ord, asset_class, allocation, status,
    max_class_weight, bucket)``. Each sleeve is scaled by its share of the live allocation, cut to the
    room its class has left after the sleeves before it, and to 5% when experimental. The order matters
    between sleeves only, so the ordered step runs over one number per sleeve, then a factor is applied
    to the rows.
    """
    keys = list(by)
    live = sleeves.where("status = 'live'")
    total_alloc = live.agg(F.sum("allocation")).scalar()
    share = safe_div(c("allocation"), F.when(total_alloc != 0, total_alloc).otherwise(1.0))
    live = live.withColumn("_share", share)
    sums = targets.groupBy(*keys, "sleeve").agg(F.sum("weight").alias("_sum")).join(live, "sleeve")
    entry = F.struct("ord", "sleeve", "asset_class", (c("_sum") * c("_share")).alias("scaled"), "max_class_weight", "bucket")
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_s"))

    def step(done, s):
        used = F.aggregate(F.filter(done, lambda x: x["cls"] == s["asset_class"]), F.lit(0.0), lambda a, x: a + x["used"])
        room = F.greatest(s["max_class_weight"] - used, F.lit(0.0))
        kept = F.when(s["scaled"] > 0, F.least(s["scaled"], room)).otherwise(s["scaled"])
        kept = F.when((s["bucket"] == "experimental") & (kept > 0), F.least(kept, F.lit(EXPERIMENTAL_CAP))).otherwise(kept)
        factor = F.coalesce(F.try_divide(kept, s["scaled"]), F.lit(1.0))
        return F.concat(done, F.array(F.struct(s["sleeve"].alias("sleeve"), s["asset_class"].alias("cls"), kept.alias("used"), factor.alias("factor"))))

    empty = F.array().cast("array<struct<sleeve:string,cls:string,used:double,factor:double>>")
    factors = packed.select(*keys, F.explode(F.aggregate("_s", empty, step)).alias("f")).select(*keys, c("f.sleeve").alias("sleeve"), c("f.factor").alias("_f"))
    return (
        targets.join(factors, [*keys, "sleeve"]).join(live.select("sleeve", "_share"), "sleeve")
        .groupBy(*keys, "ticker").agg(F.sum(c("weight") * c("_share") * c("_f")).alias("weight")).where("weight > 0")
    )


def sleeve_totals(targets: DataFrame, class_of: Column, by: Sequence[str] = BOOK) -> DataFrame:
    """Exposure per asset class; cash is what is not deployed."""
    t = targets.withColumn("_c", class_of)
    picks = [F.sum(F.when(c("_c") == k, c("weight")).otherwise(0.0)).alias(k) for k in ("stocks", "crypto", "metals")]
    return t.groupBy(*by).agg(*picks, F.sum("weight").alias("exposure")).withColumn(
        "cash", F.greatest(1 - c("exposure"), F.lit(0.0)))


def reweight_sleeves(perf: DataFrame, prior: DataFrame | None = None, blend: float = 0.5, min_days: int = 20) -> DataFrame:
    """Allocation by positive realised Sharpe; under ``min_days`` days counts as none; equal when nobody
    has any; blended with the prior and renormalised. ``perf(sleeve, sharpe, n_days)``, one row each."""
    w = Window.partitionBy(F.lit(1))  # one row per sleeve
    ok = (c("n_days") >= min_days) & c("sharpe").isNotNull()
    df = perf.withColumn("_s", F.when(ok, F.greatest("sharpe", F.lit(0.0))).otherwise(0.0))
    total = F.sum("_s").over(w)
    df = df.withColumn("weight", F.when(total > 0, c("_s") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))
    if prior is not None:
        df = df.join(prior.select("sleeve", c("weight").alias("_p")), "sleeve", "left").withColumn(
            "weight", blend * c("weight") + (1 - blend) * F.coalesce("_p", F.lit(0.0)))
        s = F.sum("weight").over(w)
        df = df.withColumn("weight", c("weight") / F.when(s != 0, s).otherwise(1.0))
    return df.select("sleeve", "weight")


def learning_multipliers(perf: DataFrame) -> DataFrame:
    """Weight over the largest weight; 1 for all while nobody has a defined Sharpe."""
    w = Window.partitionBy(F.lit(1))  # one row per sleeve
    weights = reweight_sleeves(perf)
    known = perf.agg(F.max(((c("n_days") >= 1) & c("sharpe").isNotNull()).cast("int"))).scalar()
    top = F.max("weight").over(w)
    mult = F.least(safe_div(c("weight"), F.when(top != 0, top).otherwise(1.0)), F.lit(1.0))
    return weights.withColumn("multiplier", F.when(known == 1, mult).otherwise(1.0))


def target_notional(weights: DataFrame, equity: float) -> DataFrame:
    """Order table: rounded notional per asset."""
    return weights.withColumn("notional", F.round(equity * F.greatest("weight", F.lit(0.0)), 2)).withColumn(
        "target_weight", F.round("weight", 4))
