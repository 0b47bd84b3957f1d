"""Evidence gates for market overlays."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..operators import regime as rg
from ..operators.evaluate import performance_by
from ..operators.joins import calendar_left_join

c = F.col


def macro_gate(bench: DataFrame, risk_off: DataFrame, scale: float = 100.0, min_sharpe_gain: float = 0.05,
               min_dd_gain: float = 0.02) -> DataFrame:
    """Does cutting exposure on macro stress beat the price regime alone?

    Passes with a Sharpe gain of at least ``min_sharpe_gain``, or with a drawdown gain of at least
    ``min_dd_gain`` at no more than 0.01 Sharpe lost. A Sharpe ratio without deviation, as that of a regime
    that is never on, is unknown, and the gate does not pass on it. ``scale`` divides returns (noisy inputs).
    """
    w = rg._spec(())
    off = calendar_left_join(bench.select("date"), risk_off, ["date"], "forward")
    x = rg.classify_regime(bench).join(bench, "date").join(off, "date")
    price = c("risk_on")
    macro = F.when((price == 1) & ~F.coalesce("risk_off", F.lit(False)), 1.0).otherwise(0.0)
    x = x.select("date", ((safe_div(c("close"), F.lag("close").over(w)) - 1) / scale).alias("r"),
                 price.alias("price_regime"), macro.alias("macro_regime"))
    gated = x.select(
        "date", c("r").alias("buy_hold"),
        *[(c("r") * F.coalesce(F.lag(n).over(w), F.lit(0.0))).alias(n) for n in ("price_regime", "macro_regime")])
    series = gated.unpivot(["date"], ["buy_hold", "price_regime", "macro_regime"], "strategy", "ret").where("ret IS NOT NULL")
    perf = performance_by(series)
    pick = lambda s, v: F.max(F.when(c("strategy") == s, c(v)))
    out = perf.agg(
        pick("buy_hold", "sharpe").alias("buy_hold_sharpe"), pick("price_regime", "sharpe").alias("price_sharpe"),
        pick("macro_regime", "sharpe").alias("macro_sharpe"),
        (pick("macro_regime", "sharpe") - pick("price_regime", "sharpe")).alias("sharpe_gain"),
        (pick("macro_regime", "max_drawdown") - pick("price_regime", "max_drawdown")).alias("dd_gain"))
    passed = (c("sharpe_gain") >= min_sharpe_gain) | ((c("dd_gain") >= min_dd_gain) & (c("sharpe_gain") >= -0.01))
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))
