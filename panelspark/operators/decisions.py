"""Scores to governed decisions, and the ranked report lists; all dates and sleeves at once."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, first_match, graduated_multiplier
from ..functions.ranks import rank_pct
from .cross_section import with_pick_rank

c = F.col


def decide(scores: DataFrame, max_weight: float | Column = 0.08, top_q: float | Column = 0.30, floor: float = 60.0, cost: float = 0.001,
           by: Sequence[str] = ("strategy", "date")) -> DataFrame:
    """One decision per asset.

    ``scores(by, ticker, score, current, risk_on, governor, overload)``; the last three repeat per book.
    Confidence is the percentile; the picks get a graduated base weight; exposure is the governor's, zero
    when the regime is off, halved when the picks are too correlated.
    """
    s = with_pick_rank(scores.drop("pos"), top_q, by)
    w = Window.partitionBy(*by)
    s = s.withColumn("_pct", rank_pct("score", by) * 100)
    s = s.withColumn("_raw", F.when(c("_rn") <= c("_k"), graduated_multiplier("_pct")).otherwise(0.0))
    total = F.sum("_raw").over(w)
    exposure = c("governor") * F.when(c("risk_on"), 1.0).otherwise(0.0) * F.when(c("overload"), 0.5).otherwise(1.0)
    s = s.withColumns({
        "_tgt": clip(F.when(total > 0, c("_raw") / total).otherwise(0.0) * exposure, 0.0, max_weight),
        "_cur": F.coalesce("current", F.lit(0.0)),
        "_ev": c("score") - cost,
    })
    exit_ = F.when(c("_cur") > 0, "SELL").otherwise("NO TRADE")
    ladder = [
        (c("governor") <= 0, "governor", "HIGH", exit_),
        (~c("risk_on"), "regime", "HIGH", F.when(c("_cur") > c("_tgt"), "REDUCE").when(c("_tgt") == 0, "NO TRADE").otherwise("HOLD")),
        (c("_ev") <= 0, "no_edge", "MEDIUM", exit_),
        ((c("_pct") < floor) & (c("_tgt") == 0), "low_confidence", "MEDIUM", exit_),
        (c("_tgt") > c("_cur") + 1e-6, "scale_up", "LOW", F.lit("BUY")),
        (c("_tgt") < c("_cur") - 1e-6, "trim", "LOW", F.lit("REDUCE")),
    ]
    return s.select(
        *by, "ticker",
        first_match([(k, a) for k, _, _, a in ladder], "HOLD").alias("action"),
        F.round("_ev", 5).alias("ev_score"),
        first_match([(k, risk) for k, _, risk, _ in ladder], "LOW").alias("risk_status"),
        F.round("_pct", 1).alias("confidence"),
        F.round("_tgt", 4).alias("target_weight"),
        first_match([(k, why) for k, why, _, _ in ladder], "at_target").alias("reasoning"),
    )


def top_n(scores: DataFrame, decisions: DataFrame, targets: DataFrame, prices: DataFrame, n: int = 25,
          only: Column | None = None, by: Sequence[str] = ("date",)) -> DataFrame:
    """The n best assets by composite score with every mandated field.

    BUY when held as a target, else the decision's SELL / REDUCE, else WATCH from 70 on, else the
    decision. Ties are broken by the asset.
    """
    keys = [*by, "ticker"]
    s = scores.where(only) if only is not None else scores
    x = (
        s.select(*keys, "composite")
        .join(decisions.select(*keys, "action", "ev_score", "risk_status", "confidence", "reasoning"), keys, "left")
        .join(targets.select(*keys, c("weight").alias("_t")), keys, "left")
        .join(prices.select(*keys, c("close").alias("_px")), keys, "left")
    )
    action = first_match([
        (F.coalesce(c("_t") > 0, F.lit(False)), "BUY"), (c("action").isin("SELL", "REDUCE"), c("action")),
        (c("composite") >= 70, "WATCH"),
    ], F.coalesce("action", F.lit("HOLD")))
    w = Window.partitionBy(*by).orderBy(F.round("composite", 1).desc(), "ticker")
    band = F.concat(F.round(c("_px") * 0.99, 2).cast("string"), F.lit("-"), F.round(c("_px") * 1.01, 2).cast("string"))
    ranked = x.withColumn("place", F.row_number().over(w)).where(c("place") <= n)
    return ranked.select(
        *by, "place", c("ticker").alias("asset"), F.round("composite", 1).alias("score"), action.alias("action"),
        F.round("ev_score", 5).alias("ev"), F.coalesce("risk_status", F.lit("n/a")).alias("risk"),
        F.round("confidence", 0).alias("confidence"), F.round(F.coalesce("_t", F.lit(0.0)) * 100, 2).alias("position_size"),
        F.coalesce(band, F.lit("n/a")).alias("entry_range"), F.lit("stop -8% or regime->bear/crisis").alias("exit_criteria"),
        F.coalesce("reasoning", F.lit("scored, not selected")).alias("reasoning"),
    )


def top_signals(decisions: DataFrame, n: int = 10) -> DataFrame:
    """Largest expected values; a bounded heap per partition, no full sort."""
    return decisions.where("ev_score IS NOT NULL").orderBy(c("ev_score").desc(), "ticker").limit(n)


def top_risks(targets: DataFrame, n: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Largest held weights, of all or of each book; every task keeps its best n before anything moves."""
    held = targets.where("weight > 0")
    order = [c("weight").desc(), c("ticker"), c("date")] if "date" in targets.columns else [c("weight").desc(), c("ticker")]
    if not by:
        return held.orderBy(*order).limit(n)
    return held.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(c("_place") <= n).drop("_place")
