"""Performance, rank-correlation and significance statistics as grouped aggregates."""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_match, safe_div, total
from ..functions.ranks import rank_columns
from ..functions.windows import series
from .joins import pair_folds, score_target_join
from .moments import co_moments, collect_co_moments, greedy_prune

c = F.col
DAYS = 252
ROOT = math.sqrt(DAYS)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are known; null for under two rows or no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) > 1, safe_div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


# --- rank correlation --------------------------------------------------------------------------------


def rank_ic_by_date(pairs: DataFrame, keys: Sequence[str] = (), names: int | None = None) -> DataFrame:
    """Spearman correlation of score and target per date (and key); undefined dates are left out.

    ``names`` bounds the rows of a date and key; it is counted if not known, and dates too large for a task are split.
    """
    by = [*keys, "date"]
    known = pairs.where("score IS NOT NULL AND target IS NOT NULL")
    ranked = rank_columns(known, {"_rx": ("score", by), "_ry": ("target", by)}, ("ticker",), names)
    return ranked.groupBy(*by).agg(safe_corr(c("_rx"), c("_ry")).alias("ic")).where("ic IS NOT NULL")


def ic_summary(ics: DataFrame, keys: Sequence[str] = (), horizon: int = 1) -> DataFrame:
    """Mean, deviation and annualised ratio; ``icir_overlap_adj`` counts h-day labels once per h days."""
    agg = ics.groupBy(*keys).agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"))
    ratio = F.when(c("ic_std") > 0, c("ic_mean") / c("ic_std"))
    return agg.withColumns({"icir": ratio * ROOT, "icir_overlap_adj": ratio * math.sqrt(DAYS / horizon)})


def ic_by_year(ics: DataFrame) -> DataFrame:
    return ics.groupBy(F.year("date").cast("long").alias("year")).agg(F.avg("ic").alias("ic_mean"))


def ic_by_regime(ics: DataFrame, regime: DataFrame) -> DataFrame:
    """Mean rank correlation and days per regime label; one label per date, so the labels broadcast."""
    return ics.join(F.broadcast(regime.select("date", "regime")), "date").groupBy("regime").agg(
        F.avg("ic").alias("ic_mean"), F.count(F.lit(1)).alias("n_days"))


def signal_decay(scores: DataFrame, bars: DataFrame, horizons: Sequence[int] = (5, 10, 20, 40, 60, 120), names: int | None = None) -> DataFrame:
    """Mean rank correlation with the de-meaned forward return at several horizons.

    All leads in one window pass; the horizon becomes a key, so every horizon shares the rest.
    """
    w = series()
    fwd = {str(h): safe_div(F.lead("close", h).over(w), c("close")) - 1 for h in horizons}
    wide = bars.select("date", "ticker", *[v.alias(k) for k, v in fwd.items()])
    long = wide.unpivot(["date", "ticker"], list(fwd), "horizon", "target").where("target IS NOT NULL")
    # de-meaning shifts all names of a date alike, which no rank notices
    pairs = score_target_join(scores.select("date", "ticker", "score"), long)
    return rank_ic_by_date(pairs, ["horizon"], names).groupBy(c("horizon").cast("long").alias("horizon")).agg(
        F.avg("ic").alias("ic_mean"))


def ic_significance(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """t statistic over non-overlapping folds; null below two folds."""
    agg = folds.where("ic IS NOT NULL").groupBy(*keys).agg(
        F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s"), F.count(F.lit(1)).alias("n_folds"))
    enough = c("n_folds") >= 2
    return agg.select(
        *keys, F.when(enough, c("_m")).alias("mean"), F.when(enough, c("_s")).alias("std"),
        F.when(enough & (c("_s") > 0), c("_m") / (c("_s") / F.sqrt("n_folds"))).alias("t_stat"), "n_folds")


def source_verdict(base: DataFrame, full: DataFrame, min_gain: float = 0.002, t_threshold: float = 2.0) -> DataFrame:
    """Paired test of the fold gains of a candidate over the baseline."""
    agg = pair_folds(base, full).withColumn("d", c("full") - c("base")).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("d").alias("_m"), F.stddev_samp("d").alias("_s"))
    enough = c("n_folds") >= 3
    t = F.when(enough & (c("_s") > 0), c("_m") / (c("_s") / F.sqrt("n_folds")))
    out = agg.select("n_folds", F.when(enough, c("_m")).alias("mean_gain"), t.alias("t_stat"))
    passed = F.coalesce((c("mean_gain") > min_gain) & (c("t_stat") > t_threshold), F.lit(False))
    verdict = first_match([
        (c("n_folds") < 3, "INSUFFICIENT_FOLDS"), (passed, "PASS"), (c("mean_gain") < -min_gain, "HURTS"),
    ], "NO_EDGE")
    return out.withColumns({"passed": passed, "verdict": verdict})


# --- feature correlation ---------------------------------------------------------------------------------


def feature_corr(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlation of every feature pair ``(a, b, corr)`` over the rows where both are known, from one pass of matrix products."""
    k = len(features)
    m = co_moments(panel, features)
    cells = []
    for i in range(k):
        for j in range(i + 1, k):
            at, back = i * k + j, j * k + i
            scale = F.sqrt(c("var")[at]) * F.sqrt(c("var")[back])
            cells.append(F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), F.when(c("n")[at] > 1, safe_div(c("co")[at], scale)).alias("corr")))
    return m.select(F.inline(F.array(*cells)))


def redundancy(panel: DataFrame, features: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs above the threshold, strongest first."""
    pairs = feature_corr(panel, features).where(F.abs("corr") > threshold)
    return pairs.orderBy(F.abs("corr").desc(), "a", "b")


def prune_correlated(panel: DataFrame, features: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Keep a feature when it is not too close to one kept before; only the K x K moments reach the driver."""
    state = collect_co_moments(panel, features).get(0)
    return greedy_prune(state.corr(), features, threshold) if state else list(features)


def feature_target_corr(panel: DataFrame, features: Sequence[str], target: str = "target", limit: float = 0.95) -> DataFrame:
    """Correlation of every feature with the label and whether it looks like a leak."""
    row = panel.agg(*[safe_corr(c(f), c(target)).alias(f) for f in features])
    return row.unpivot([], list(features), "feature", "corr").withColumn(
        "leak", F.coalesce(F.abs("corr") > limit, F.lit(False)))


# --- return series -----------------------------------------------------------------------------------------


def compounded(ret="ret") -> Column:
    """Product of 1 + r as an aggregate that combines on the map side."""
    return F.product(1 + c(ret))


def nav_drawdown(returns: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """nav, running peak (without the starting 1) and drawdown per date."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        returns.withColumn("nav", F.product(1 + c("ret")).over(w))
        .withColumn("peak", F.max("nav").over(w))
        .withColumn("drawdown", safe_div(c("nav"), c("peak")) - 1)
    )


def max_drawdown(returns: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    return nav_drawdown(returns, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def return_stats(ret="ret") -> dict[str, Column]:
    """Aggregates of one return series; ``n`` days, zero returns do not count in the win rate."""
    r = c(ret)
    sd, mean = F.stddev_samp(r), F.avg(r)
    down = F.stddev_samp(F.when(r < 0, r))
    growth = compounded(ret)
    n = F.count(r)
    return {
        "n_days": n,
        "cagr": F.when(growth > 0, F.pow(growth, DAYS / n) - 1),
        "ann_vol": sd * ROOT,
        "sharpe": F.when(sd > 0, mean / sd * ROOT),
        "sortino": F.when(down > 0, mean / down * ROOT),
        "win_rate": F.avg(F.when(r != 0, (r > 0).cast("double"))),
        "total_return": growth - 1,
    }


def performance_by(returns: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """All statistics for many series at once; the drawdown is the only part that needs the order."""
    nav = nav_drawdown(returns, keys)
    out = nav.groupBy(*keys).agg(
        *[v.alias(k) for k, v in return_stats().items()], F.min("drawdown").alias("max_drawdown"))
    return out.withColumn("calmar", F.when(c("max_drawdown") < 0, safe_div(c("cagr"), F.abs("max_drawdown"))))


def against_benchmark(perf: DataFrame, benchmark: str) -> DataFrame:
    """Winner flags of every strategy against one row of the same table."""
    w = Window.partitionBy(F.lit(1))  # one row per strategy
    ref = lambda v: F.max(F.when(c("strategy") == benchmark, c(v))).over(w)
    flags = {"beats_sharpe": c("sharpe") > ref("sharpe"), "beats_return": c("total_return") > ref("total_return"),
             "smaller_drawdown": c("max_drawdown") > ref("max_drawdown")}
    return perf.withColumns(flags)


def cvar(returns: DataFrame, alpha: float = 0.05, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean of the returns at or below the alpha quantile."""
    q = returns.groupBy(*keys).agg(F.percentile("ret", F.lit(alpha)).alias("var"))  # one row per series
    return returns.join(q, list(keys)).where("ret <= var").groupBy(*keys).agg(
        F.first("var").alias("var"), F.avg("ret").alias("cvar"))


def stress_tests(returns: DataFrame, costs: DataFrame | None = None, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Three mechanical shocks per series.

    ``costs(keys, avg_turnover, n_rebalances)``: +5 bps per unit of turnover spread over the days;
    without it a flat 5 bps a day. Then: days at or below the 1% quantile doubled, and the best 5%
    removed.
    """
    k = list(keys)
    of_series = returns.groupBy(*k).agg(F.count("ret").alias("_n"), F.percentile("ret", F.array(F.lit(0.01), F.lit(0.95))).alias("_q"))
    base = returns.join(of_series, k)
    if costs is not None:
        years = F.greatest(c("_n") / 252.0, F.lit(1e-9))
        base = base.join(costs, k).withColumn("stress_cost_extra_annual", c("avg_turnover") * (c("n_rebalances") / years) * 0.0005)
        base = base.withColumn("_drag", c("stress_cost_extra_annual") / 252.0)
    else:
        base = base.withColumns({"stress_cost_extra_annual": F.lit(None).cast("double"), "_drag": F.lit(0.0005)})
    lo, hi = c("_q")[0], c("_q")[1]
    r = base.withColumns({
        "_dragged": c("ret") - c("_drag"),
        "_tail": F.when(c("ret") <= lo, c("ret") * 2).otherwise(c("ret")),
        "_calm": F.when(c("ret") < hi, c("ret")),
    })
    w = Window.partitionBy(*k).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_nav", F.product(1 + c("_tail")).over(w)).withColumn("_dd", safe_div(c("_nav"), F.max("_nav").over(w)) - 1)
    growth = F.product(F.when(c("_calm").isNotNull(), 1 + c("_calm")).otherwise(1.0))
    sd = F.stddev_samp("_dragged")
    return r.groupBy(*k).agg(
        F.when(sd > 0, F.avg("_dragged") / sd * ROOT).alias("stress_cost_5bps_sharpe"),
        F.first("stress_cost_extra_annual").alias("stress_cost_extra_annual"),
        F.min("_dd").alias("stress_fattail_maxdd"),
        F.when((growth > 0) & (F.count("_calm") > 0), F.pow(growth, 252.0 / F.count("_calm")) - 1).alias("stress_no_luck_cagr"),
    )


def avg_pairwise_corr(basket: DataFrame, threshold: float = 0.80, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Mean off-diagonal correlation of the names of each basket.

    ``basket(keys, date, ticker, ret)``, complete rows only. With every name standardised, the variance
    of the daily sum over k names is k + (k^2 - k) * mean correlation: two aggregates, no pairs.
    """
    k = list(keys)
    name = Window.partitionBy(*k, "ticker")
    z = basket.withColumns({"_m": F.avg("ret").over(name), "_s": F.stddev_pop("ret").over(name)}).where("_s > 0")
    # every name is there on every date, so any date counts the names
    daily = z.groupBy(*k, "date").agg(F.sum((c("ret") - c("_m")) / c("_s")).alias("_sum"), F.count(F.lit(1)).alias("_names"))
    out = daily.groupBy(*k).agg(F.var_pop("_sum").alias("_v"), F.max("_names").cast("double").alias("k"))
    return out.select(
        *k, c("k").cast("long").alias("n_names"),
        F.when(c("k") >= 2, (c("_v") - c("k")) / (c("k") * c("k") - c("k"))).alias("avg_corr"),
    ).withColumn("overload", F.coalesce(c("avg_corr") > threshold, F.lit(False)))


def best_model(fold_ics: DataFrame) -> DataFrame:
    """Model with the largest mean; a model without any value counts as -9."""
    means = fold_ics.groupBy("model").agg(F.coalesce(F.avg("ic"), F.lit(-9.0)).alias("ic_mean"))
    return means.agg(F.max_by(F.struct("model", "ic_mean"), F.struct("ic_mean", "model")).alias("_b")).select("_b.*")


def leak_canary(panel: DataFrame, target: str = "target") -> DataFrame:
    """One row ``(leak_caught)``: does the audit flag a planted feature that is the label on another scale?"""
    planted = panel.select(target, (c(target) * 0.5 + 3.0).alias("canary"))
    return feature_target_corr(planted, ["canary"], target).select(c("leak").alias("leak_caught"))


def seed_sweep(results: DataFrame, canary: DataFrame) -> DataFrame:
    """``results(strength, seed, ic)``, three strengths: mean and deviation each, and the verdicts; ``passed`` needs all.

    ``canary`` is the row of :func:`leak_canary`. The limits are fixed values.

    Recovery: both signals beat none, and the strong one the faint one within a deviation. No made-up
    signal: the mean at strength 0 is inside the sampling noise and far below the strong one.
    """
    by = results.groupBy("strength").agg(
        F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row per strength
    pick = lambda s, v: F.max(F.when(c("strength") == s, c(v))).over(w)
    m0, m1, m4 = pick(0.0, "mean"), pick(1.0, "mean"), pick(4.0, "mean")
    se0 = pick(0.0, "std") / F.sqrt(pick(0.0, "n"))
    recovery = (m1 > m0) & (m4 > m0) & (m4 >= m1 - pick(4.0, "std"))
    quiet = (F.abs(m0) < F.greatest(F.lit(0.04), 2.5 * se0)) & (F.abs(m0) < 0.5 * F.greatest(m4, F.lit(1e-9)))
    out = by.select("strength", "mean", "std", "n", recovery.alias("recovery"), quiet.alias("no_hallucination"), canary.scalar().alias("leak_caught"))
    return out.withColumn("passed", c("recovery") & c("no_hallucination") & c("leak_caught"))


def crosscheck(a: DataFrame, b: DataFrame, tol: float = 1e-6, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Largest absolute difference of two versions of the same return series."""
    both = a.select(*keys, "date", "ret").join(b.select(*keys, "date", c("ret").alias("_o")), [*keys, "date"])
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(c("ret") - c("_o"))).alias("max_diff")).withColumn(
        "ok", c("max_diff") <= tol)
