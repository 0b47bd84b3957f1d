"""The feature panel: bars to labelled, ranked, winsorised features in two exchanges."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_nonfinite, drop_incomplete
from ..functions.ranks import rank_columns
from ..functions.windows import add_features, merge_levels
from ..operators import cross_section as xs
from ..operators import fundamentals as fund
from ..operators import relative
from ..operators.joins import sector_join, with_membership
from ..operators.technical import single_name_features
from ..session import stored

c = F.col

#: fixed values: the features of each family
TREND = {"adx", "kama_dist", "hull_dist", "supertrend", "trend_slope", "trend_r2"}
VOLUME = {"rel_volume", "obv_z", "cmf", "vwap_dist", "vol_accel"}
MEAN_REVERSION = {"boll_z", "ema_dist", "pct_rank_60", "rsi"}
VOLATILITY = ("realized_vol", "atr_pct", "parkinson", "yang_zhang", "vol_of_vol")

#: fixed values: family name -> does a feature belong to it; a new family is one more entry
FAMILIES = {
    "momentum": lambda f: f.startswith("mom_"),
    "trend": lambda f: f in TREND,
    "volume": lambda f: f in VOLUME,
    "volatility": lambda f: f.startswith(VOLATILITY),
    "mean_reversion": lambda f: f in MEAN_REVERSION,
    "relative_strength": lambda f: f.startswith(("rs_", "beta_")),
    "breadth": lambda f: f.startswith("breadth_"),
    "cross_sectional": lambda f: f.startswith("csrank_"),
    "fundamental": lambda f: f.startswith("f_"),
    "insider": lambda f: f.startswith("i_"),
}


def factor_families(features: Sequence[str]) -> dict[str, list[str]]:
    out = {name: [f for f in features if test(f)] for name, test in FAMILIES.items()}
    return {k: v for k, v in out.items() if v}


def select_families(features: Sequence[str], families: Sequence[str]) -> list[str]:
    """Columns of the chosen families, in panel order."""
    member = factor_families(features)
    keep = {f for name in families for f in member.get(name, [])}
    return [f for f in features if f in keep]


@dataclass(frozen=True)
class PanelConfig:
    horizon: int = 20
    momentum_windows: tuple = (5, 10, 20, 40, 60, 120)
    vol_windows: tuple = (10, 20, 60)
    breadth_mas: tuple = (20, 50, 200)
    winsorize_pct: float = 0.01
    sector_neutral: bool = False
    keep_unlabeled: bool = False


def build_panel(bars: DataFrame, bench: DataFrame, cfg: PanelConfig = PanelConfig(), refs: DataFrame | None = None,
                ref_names: Sequence[str] = (), sectors: DataFrame | None = None, membership: DataFrame | None = None,
                filings: DataFrame | None = None, insider: DataFrame | None = None,
                n_names: int | None = None) -> tuple[DataFrame, list[str]]:
    """Panel and its feature columns.

    ``bars`` aligned long bars with ``pos``; ``bench(date, close)``; ``refs(date, ref, close)`` with
    ``ref_names`` the series to use; ``n_names`` the size of the universe if known. The bars pass once
    through an exchange by ticker (filings, flows and all per-ticker features) and once through an
    exchange by date (breadth, ranks, label, quantiles); nothing is joined back to itself.
    """
    by_date = bench.select("date", c("close").alias("_bench"))
    if refs is not None:
        picks = [F.max(F.when(c("ref") == n, c("close"))).alias(f"_ref_{n}") for n in ref_names]
        by_date = by_date.join(refs.where(c("ref").isin(*ref_names)).groupBy("date").agg(*picks), "date")
    p = fund.event_columns(bars, filings, insider)
    if sectors is not None:
        p = sector_join(p, sectors)
    if membership is not None:
        p = with_membership(p, membership, "_member")
    levels = single_name_features(cfg.momentum_windows, cfg.vol_windows)
    levels += [relative.relative_strength_column("rs_bench", "_bench")]
    levels += [relative.relative_strength_column(f"rs_{n}", f"_ref_{n}") for n in ref_names]
    levels += [relative.rolling_beta_levels("beta_bench", "_bench"), xs.forward_return(cfg.horizon)]
    flags = relative.breadth_flags(cfg.breadth_mas)
    levels.append(flags)
    if insider is not None:
        levels.append([{}, {}, fund.insider_columns()])
    ranked: list[tuple[str, str]] = []
    if filings is not None:
        levels.append([fund.ratio_columns()])
        ranked += [(x, f"f_{x}") for x in fund.FUNDAMENTAL_COLS]
    if insider is not None:
        ranked += [(x, f"i_{x}") for x in fund.INSIDER_COLS]
    shares = [f"_is_{k}" for k in [x[4:] for x in flags[2]]]
    keep = [x for level in merge_levels(*levels) for x in level if not x.startswith("_")]
    p = add_features(relative.market_join(p, by_date), levels, keep=list(dict.fromkeys(keep + shares)))
    # from here on by date
    market = Window.partitionBy("date")
    # a date has at most every name once: this bound decides between windows and split dates below
    n_names = n_names or bars.agg(F.countDistinct("ticker").alias("n")).first().n
    p = p.withColumns({x[4:]: F.sum(x).over(market) / F.lit(n_names) for x in shares}).drop(*shares)
    p = rank_columns(p, {out: (raw, ("date",)) for raw, out in ranked}, ("ticker",), n_names)
    p = p.withColumns({out: F.coalesce(c(out) - 0.5, F.lit(0.0)) for _, out in ranked})
    p = xs.add_ranked_signals(p.drop(*[raw for raw, _ in ranked]), cfg.sector_neutral, n_names)
    if membership is not None:
        p = p.withColumn("fwd", F.when(c("_member"), c("fwd")))
    p = xs.demean_target(p, ("date", "sector") if cfg.sector_neutral else ("date",))
    not_features = {*bars.columns, *fund.CONCEPTS, "rev_growth_yoy", "ni_growth_yoy", "signed_value", "purchases",
                    "fwd", "target", "sector"}
    features = [x for x in p.columns if x not in not_features and not x.startswith("_")]
    # written once: the quantiles of all columns are one grouped aggregate over it, and the rows meet them again
    p = stored(bars.sparkSession, clean_nonfinite(p.select("date", "pos", "ticker", *features, "target")), "ranked-panel")
    p = xs.winsorize(p, features, cfg.winsorize_pct, stored=True, names=n_names)
    return drop_incomplete(p, features, cfg.keep_unlabeled), features
