"""Per-date operators across names."""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import graduated_multiplier, safe_div
from ..functions.ranks import GROUP_ROWS, largest_group, quantile_bounds, quantile_bounds_split, quantile_pair, rank_columns, rank_pct
from ..functions.windows import add_features, series
from ..session import stored as written
from .joins import interval_join

c = F.col


def cs_rank(x, by: Sequence[str] = ("date",)) -> Column:
    """Centred percentile rank in (-0.5, 0.5]."""
    return rank_pct(x, by) - 0.5


def sector_rank(x) -> Column:
    return cs_rank(x, ("date", "sector"))


def winsorize(panel: DataFrame, cols: Sequence[str], p: float = 0.01, stored: bool = False, by: Sequence[str] = ("date",),
              names: int | None = None) -> DataFrame:
    """Clip every column to its quantiles per date (or other group).

    By default the quantiles are window aggregates, so a panel that is still a plan is computed once and
    shares the exchange by date with the ranks. A ``stored`` panel (a written table, cheap to read twice)
    takes its bounds from one grouped aggregate instead, which combines on the map side, and the bounds (one row
    per group) come back by broadcast. Groups beyond what a task should hold (``names`` bounds their rows and is
    counted if not known) take the same values from histograms, and no task sees a group.
    """
    if p <= 0:
        return panel
    keys = list(by)
    if (largest_group(panel, keys) if names is None else names) > GROUP_ROWS:
        panel = panel if stored else written(panel.sparkSession, panel, "winsorize")
        source = panel.join(F.broadcast(quantile_bounds_split(panel, cols, p, keys)), keys)
    elif stored:
        source = panel.join(F.broadcast(quantile_bounds(panel, cols, p, keys)), keys)
    else:
        w = Window.partitionBy(*keys)
        source = panel.withColumns({f"_q_{x}": quantile_pair(x, p).over(w) for x in cols})
    clipped = {x: F.when(c(x).isNotNull(), F.greatest(F.least(c(x), c(f"_q_{x}")[1]), c(f"_q_{x}")[0])) for x in cols}
    return source.withColumns(clipped).select(*panel.columns)


def forward_return(h: int, name: str = "fwd"):
    return [{name: safe_div(F.lead("close", h).over(series()), c("close")) - 1}]


def member_forward_return(bars: DataFrame, h: int, membership: DataFrame | None = None) -> DataFrame:
    """Label before de-meaning; names outside the universe on a date carry no label."""
    out = add_features(bars, [forward_return(h)])
    return interval_join(out, membership) if membership is not None else out


def demean_target(labels: DataFrame, by: Sequence[str] = ("date",), fwd: str = "fwd") -> DataFrame:
    """Forward return minus its mean over the market or the sector; shares the exchange of the ranks."""
    return labels.withColumn("target", c(fwd) - F.avg(fwd).over(Window.partitionBy(*by)))


def ranked_signals() -> Mapping[str, Column]:
    """The five base signals that get ranked per date."""
    return {
        "csrank_mom": c("mom_20"),
        "csrank_vol": c("realized_vol_20"),
        "csrank_rs": c("rs_bench"),
        "csrank_liquidity": c("volume") * c("close"),
        "csrank_quality": -F.coalesce(c("realized_vol_60"), F.lit(0.0)) + F.coalesce(c("trend_r2"), F.lit(0.0)),
    }


def add_ranked_signals(panel: DataFrame, sector_neutral: bool = False, names: int | None = None) -> DataFrame:
    by = ("date", "sector") if sector_neutral else ("date",)
    signals = ranked_signals()
    out = panel.withColumns({f"_b_{k}": v for k, v in signals.items()})
    out = rank_columns(out, {k: (f"_b_{k}", by) for k in signals}, ("ticker",), names)
    return out.withColumns({k: c(k) - 0.5 for k in signals}).drop(*[f"_b_{k}" for k in signals])


def rank_fill_neutral(panel: DataFrame, cols: Sequence[str], prefix: str, names: int | None = None) -> DataFrame:
    """Centred rank with missing as neutral 0."""
    out = rank_columns(panel, {f"{prefix}{x}": (x, ("date",)) for x in cols}, ("ticker",), names)
    return out.withColumns({f"{prefix}{x}": F.coalesce(c(f"{prefix}{x}") - 0.5, F.lit(0.0)) for x in cols})


def blend_horizons(scores: DataFrame, weights: Mapping[int, float]) -> DataFrame:
    """``scores(date, ticker, horizon, score)``: rank per horizon, weighted sum, missing counts 0."""
    total = sum(weights.values()) or 1.0
    w = F.create_map(*[x for h, v in weights.items() for x in (F.lit(h), F.lit(v / total))])
    z = scores.where(c("horizon").isin(*[h for h, v in weights.items() if v])).withColumn(
        "_z", cs_rank("score", ("date", "horizon")))
    return z.groupBy("date", "ticker").agg(F.sum(F.try_element_at(w, "horizon") * c("_z")).alias("score"))


def _by_score(by: Sequence[str], desc: bool = True):
    s = c("score").desc() if desc else c("score").asc()
    # ties at a cut are broken by the ticker
    return Window.partitionBy(*by).orderBy(s, c("ticker").asc() if desc else c("ticker").desc())


def with_pick_rank(scores: DataFrame, q: float | Column, by: Sequence[str] = ("date",)) -> DataFrame:
    """Adds ``_rn`` (1 = best) and ``_k`` = max(ceil(n q), 1) over the non-null scores."""
    s = scores.where("score IS NOT NULL")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return s.withColumns({
        "_rn": F.row_number().over(_by_score(by)),
        "_n": n,
        "_k": F.greatest(F.ceil(n * F.lit(q)), F.lit(1)),
    })


def top_quantile(scores: DataFrame, q: float, by: Sequence[str] = ("date",)) -> DataFrame:
    return with_pick_rank(scores, q, by).where("_rn <= _k").drop("_n", "_k").withColumnRenamed("_rn", "pick")


def long_short_legs(scores: DataFrame, q: float, by: Sequence[str] = ("date",)) -> DataFrame:
    """+0.5/k on the top k, -0.5/k on the bottom k; dates with under four names hold nothing."""
    r = with_pick_rank(scores, q, by).where("_n >= 4")
    long, short = c("_rn") <= c("_k"), c("_rn") > c("_n") - c("_k")
    legs = r.where(long | short).withColumn(
        "weight", F.when(long, 0.5 / c("_k")).otherwise(0.0) - F.when(short, 0.5 / c("_k")).otherwise(0.0))
    return legs.drop("_rn", "_n", "_k")


def normalize(weights: DataFrame, col: str = "weight", by: Sequence[str] = ("date",)) -> DataFrame:
    """Divide by the group's sum (kept as is when the sum is not positive)."""
    total = F.sum(col).over(Window.partitionBy(*by))
    return weights.withColumn(col, F.when(total > 0, c(col) / total).otherwise(c(col)))


def overlay_weights(scores: DataFrame, tilt: float = 1.0, cap: float = 0.10, by: Sequence[str] = ("date",)) -> DataFrame:
    """Hold every name, tilted by rank; clipped at 0, normalised, capped, normalised again."""
    s = scores.where("score IS NOT NULL")
    raw = s.withColumn("weight", F.greatest(1.0 + tilt * cs_rank("score", by), F.lit(0.0)))
    capped = normalize(raw, by=by).withColumn("weight", F.least("weight", F.lit(cap)))
    return normalize(capped, by=by)


def graduated_size(weights: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """Scale by the conviction step of ``pct`` (0-100), drop what falls to 0, renormalise."""
    w = weights.withColumn("weight", c("weight") * graduated_multiplier("pct")).where("weight > 0")
    return normalize(w, by=by)


#: factor weights of the 0-100 asset score
SCORE_WEIGHTS = {
    "expected_value": 0.30, "trend_strength": 0.20, "momentum": 0.20, "low_volatility": 0.15, "liquidity": 0.15,
}


def score_assets(bars: DataFrame, model_ev: DataFrame | None = None, min_history: int = 60) -> DataFrame:
    """0-100 score of every asset on every date; 50 where the market history is too short.

    ``model_ev(date, ticker, ev)``; missing factors rank neutral (50).
    """
    w = series()
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    base = bars.withColumn("_r1", safe_div(c("close"), F.lag("close").over(w)) - 1)
    raw = base.select(
        "date", "pos", "ticker",
        (safe_div(c("close"), F.avg("close").over(frame(200))) - 1).alias("trend_strength"),
        (safe_div(c("close"), F.lag("close", 59).over(w)) - 1).alias("momentum"),
        (-F.stddev_samp("_r1").over(frame(20))).alias("low_volatility"),
        F.log1p(F.avg(c("close") * c("volume")).over(frame(20))).alias("liquidity"),
    )
    if model_ev is not None:
        raw = raw.join(model_ev.select("date", "ticker", c("ev").alias("expected_value")), ["date", "ticker"], "left")
    else:
        raw = raw.withColumn("expected_value", F.lit(None).cast("double"))
    short = c("pos") < min_history - 1
    ranked = raw.select("date", "pos", "ticker", *[
        F.when(short, 50.0).otherwise(F.coalesce(rank_pct(x) * 100, F.lit(50.0))).alias(x) for x in SCORE_WEIGHTS])
    composite = sum(c(k) * v for k, v in SCORE_WEIGHTS.items())
    return ranked.withColumn("composite", composite)
