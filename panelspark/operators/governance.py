"""Risk governor, exposure overlays, no-trade band, cash buffer.

The governor and the overlays are windows over one row per strategy and date: what a rule remembers is always
the place of its last event. The no-trade band and the cash buffer depend on what they did the day before; their
rows stream in order past one weight or one buffer.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cash_regime_scalar, kelly_exposure, vol_target_scalar
from ..functions.scan import carried

c = F.col


@dataclass(frozen=True)
class Limits:
    """Drawdowns that stop and that allow again, the loss of a day, losses in a row, days of rest."""

    max_drawdown: float = 0.20
    reenter: float = 0.10
    daily_loss: float = 0.04
    max_losses: int = 3
    cooldown_days: int = 5


def _states(returns: DataFrame, key: str, limits: Limits) -> DataFrame:
    """``_state`` after each return: drawdown, cooldown or ok; null where the return is null.

    Stopped by drawdown: the last crossing of either limit was the lower one. Resting: the last trigger (a bad
    day, or a loss that ends a run of losses long enough) lies fewer returns back than the rest lasts.
    """
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r, n = c("ret"), c("_n")
    fall = c("_nav") / c("_peak") - 1
    run = n - F.coalesce("_gain", F.lit(0))
    trigger = (r <= -limits.daily_loss) | ((r < 0) & (run >= limits.max_losses))
    crossing = F.when(r.isNotNull(), F.when(fall <= -limits.max_drawdown, True).when(fall >= -limits.reenter, False))
    return (
        returns.select(key, "date", "ret")
        .withColumns({"_n": F.count(r).over(w), "_nav": F.product(1 + r).over(w)})
        .withColumns({"_peak": F.greatest(F.lit(1.0), F.max("_nav").over(w)), "_gain": F.max(F.when(r >= 0, n)).over(w)})
        .withColumns({"_hit": F.max(F.when(trigger, n)).over(w), "_down": F.last(crossing, ignorenulls=True).over(w)})
        .withColumn("_state", F.when(r.isNotNull(), F.when(c("_down"), "drawdown").when(n - c("_hit") < limits.cooldown_days, "cooldown").otherwise("ok")))
    )


def governor(returns: DataFrame, key: str = "strategy", limits: Limits = Limits()) -> DataFrame:
    """Exposure and reason *before* each return, decided from the returns up to the day before; null returns
    change nothing."""
    before = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    reason = F.coalesce(F.last("_state", ignorenulls=True).over(before), F.lit("ok"))
    return _states(returns, key, limits).select(key, "date", reason.alias("reason")).select(
        key, "date", F.when(c("reason") == "ok", 1.0).otherwise(0.0).alias("exposure"), "reason")


def governor_today(returns: DataFrame, key: str = "strategy", limits: Limits = Limits()) -> DataFrame:
    """Exposure and reason after the whole history: what may be held next."""
    last = F.max_by("_state", F.when(c("_state").isNotNull(), c("date")))
    return _states(returns, key, limits).groupBy(key).agg(F.coalesce(last, F.lit("ok")).alias("reason")).select(
        key, F.when(c("reason") == "ok", 1.0).otherwise(0.0).alias("exposure"), "reason")


class GovernorMemory(NamedTuple):
    """What a stream keeps of a strategy's past: value, peak, and the places of the last gain and trigger."""

    nav: float = 1.0
    peak: float = 1.0
    n: int = 0
    gain: int = 0
    hit: int = -1_000_000
    down: bool = False

    def state(self, limits: Limits = Limits()) -> str:
        return "drawdown" if self.down else "cooldown" if self.n - self.hit < limits.cooldown_days else "ok"


def governor_path(returns: np.ndarray, memory: GovernorMemory, limits: Limits = Limits()) -> tuple[list[str], GovernorMemory]:
    """States after each of further returns, and the memory after the last: the windows of :func:`governor` as
    running extremes of an array."""
    r = np.asarray(returns, float)
    if not len(r):
        return [], memory
    n = memory.n + np.arange(1, len(r) + 1)
    nav = memory.nav * np.cumprod(1 + r)
    peak = np.maximum(np.maximum.accumulate(nav), memory.peak)
    gain = np.maximum.accumulate(np.where(r >= 0, n, memory.gain))
    trigger = (r <= -limits.daily_loss) | ((r < 0) & (n - gain >= limits.max_losses))
    hit = np.maximum.accumulate(np.where(trigger, n, memory.hit))
    fall = nav / peak - 1
    low, crossed = fall <= -limits.max_drawdown, (fall <= -limits.max_drawdown) | (fall >= -limits.reenter)
    place = np.maximum.accumulate(np.where(crossed, np.arange(len(r)), -1))
    down = np.where(place >= 0, low[np.maximum(place, 0)], memory.down)
    after = [GovernorMemory(float(v), float(p), int(i), int(g), int(h), bool(d)) for v, p, i, g, h, d in zip(nav, peak, n, gain, hit, down)]
    return [m.state(limits) for m in after], after[-1]


@dataclass(frozen=True)
class Scenario:
    """Overlay switches of one scenario; 0 turns a numeric overlay off."""

    name: str
    vol_target: float = 0.0
    kelly_fraction: float = 0.0
    regime_off: float = 1.0
    cash_regime: bool = False
    hard_risk: bool = False


def apply_overlays(book: DataFrame, market: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Returns of a book under exposure overlays: ``(strategy, scenario, date, exposure, gross, cost, ret)``.

    ``book(strategy, date, gross, cost, ret)`` as :func:`~.portfolio.portfolio_returns` gives it;
    ``market(date, risk_on, breadth200, market_vol)``, one row for each trading day. A day's exposure uses what
    was known the day before: cash regime x vol target (20 returns) x fractional Kelly (60 returns) x regime
    gate x governor, all measured on the book itself, so every factor is a window and scenarios share them.
    """
    w = Window.partitionBy("strategy").orderBy("date")
    past = lambda k: w.rowsBetween(-k, -1)
    known = (
        book.join(F.broadcast(market), "date", "left")
        .join(governor(book).select("strategy", "date", c("exposure").alias("_gov")), ["strategy", "date"])
        .withColumns({
            "_vol": F.stddev_samp("ret").over(past(20)) * (252 ** 0.5), "_n": F.count("ret").over(past(20)),
            "_mean": F.avg("ret").over(past(60)), "_var": F.var_samp("ret").over(past(60)), "_m": F.count("ret").over(past(60)),
            "_on": F.lag("risk_on").over(w), "_breadth": F.lag("breadth200").over(w), "_mvol": F.lag("market_vol").over(w),
        }))

    def exposure(s: Scenario) -> Column:
        out = F.lit(1.0)
        if s.cash_regime:
            out = out * F.coalesce(cash_regime_scalar("_breadth", F.coalesce("_mvol", F.lit(0.0))), F.lit(1.0))
        if s.vol_target:
            out = out * vol_target_scalar("_vol", "_n", s.vol_target)
        if s.kelly_fraction:
            out = out * kelly_exposure("_mean", "_var", "_m", s.kelly_fraction)
        if s.regime_off != 1.0:
            out = out * F.when(c("_on") < 0.5, s.regime_off).otherwise(1.0)
        return out * c("_gov") if s.hard_risk else out

    each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("scenario"), exposure(s).alias("exposure")) for s in scenarios]))
    e = c("_s.exposure")
    return known.withColumn("_s", each).select(
        "strategy", "_s.scenario", "date", e.alias("exposure"), (c("gross") * e).alias("gross"), (c("cost") * e).alias("cost"), (c("ret") * e).alias("ret"))


def no_trade_band(weights: DataFrame, band: float) -> DataFrame:
    """Weights after skipping changes below the band; each kept weight depends on the one kept before.

    ``weights(strategy, rebal_no, ticker, weight)``, absent = 0. The rows of a name stream in order past one
    carried weight. A rebalance without a row asks for 0: a kept weight below the band outlives it, any other ends.
    """
    last = weights.agg(F.max("rebal_no").alias("n")).first().n
    start = weights.groupBy("strategy").agg(F.min("rebal_no").alias("_first"))
    rows = weights.join(start, "strategy").select("strategy", "ticker", c("rebal_no").cast("long"), c("weight").cast("double"), c("_first").cast("long"))

    def fold():
        held, done = 0.0, None  # the weight kept and the last rebalance seen
        name = ()

        def through(until):
            """The rebalances without a row before ``until``."""
            nonlocal held
            if held and abs(held) >= band:
                held = 0.0
            return [(*name, k, held) for k in range(done + 1, until)] if held else []

        def step(row):
            nonlocal held, done, name
            strategy, ticker, k, new, first = row
            new, name = new or 0.0, (strategy, ticker)
            out = through(k) if done is not None and done + 1 < k else []
            if k == first or not abs(new - held) < band:
                held = new
            done = k
            return out + ([(*name, k, held)] if held else [])

        return step, lambda: through(last + 1) if done is not None and done < last else []

    return carried(rows, ["strategy", "ticker"], ["rebal_no"], fold, "strategy string, ticker string, rebal_no long, weight double").select(
        "strategy", "rebal_no", "ticker", "weight")


def cash_buffer(days: DataFrame, max_idle: int = 90) -> DataFrame:
    """Deposits wait until an opportunity or for ``max_idle`` days.

    ``days(account, date, deposit, ev_ok)``: released cash and buffer after each day. The days of an account
    stream in order past its buffer and the days it has waited; null deposits count 0, a null ``ev_ok`` is no.
    """
    def fold():
        buffer, idle = 0.0, 0

        def step(row):
            nonlocal buffer, idle
            account, date, deposit, chance = row
            buffer += max(deposit or 0.0, 0.0)
            released = 0.0
            if buffer <= 0:
                idle = 0
            elif chance or idle >= max_idle:
                released, buffer, idle = buffer, 0.0, 0
            else:
                idle += 1
            return [(account, date, released, buffer)]

        return step, list

    rows = days.select("account", "date", c("deposit").cast("double"), "ev_ok")
    return carried(rows, ["account"], ["date"], fold, "account string, date date, released double, buffer double")
