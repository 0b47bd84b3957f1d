"""Scalar expressions: arithmetic guards, parsing, sizing rules. All stay in codegen."""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADING_DAYS = 252
MICROCAP_BELOW = 2e9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def safe_div(num, den) -> Column:
    """Quotient, null when the divisor is zero or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def finite(x) -> Column:
    """Null in place of NaN and the infinities."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def clean_nonfinite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN/inf by null in every floating column (or the named ones) in one projection."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    todo = set(cols or floats)
    return df.select(*[finite(c).alias(c) if c in todo else F.col(c) for c in df.columns])


def drop_incomplete(panel: DataFrame, features: Sequence[str], keep_unlabeled: bool = False) -> DataFrame:
    """Training keeps complete rows only; inference also keeps rows whose label is still unknown."""
    return panel.dropna(subset=list(features) + ([] if keep_unlabeled else ["target"]))


def clip(x, lo, hi) -> Column:
    """Clamp; a null input stays null (``least``/``greatest`` alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.greatest(F.least(x, _c(hi)), _c(lo)))


def bucketize(x, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin ``(edges[i], edges[i+1]]``; null outside or for null."""
    x = _c(x)
    branches = [
        ((x > lo) & (x <= hi), float(i)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    ]
    return first_match(branches, None)


def first_match(rules: Sequence[tuple[Column, object]], default) -> Column:
    """Ordered rule table: value of the first condition that is true."""
    (cond, value), *rest = rules
    out = F.when(cond, _c(value) if isinstance(value, Column) else F.lit(value))
    for cond, value in rest:
        out = out.when(cond, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def clean_symbol(x) -> Column:
    return F.upper(F.trim(_c(x)))


def parse_filing_date(x) -> Column:
    """``15-FEB-2021`` first, ISO otherwise, decided value by value; null when neither parses."""
    x = _c(x)
    return F.coalesce(
        F.try_to_timestamp(x, F.lit("dd-MMM-yyyy")), F.try_to_timestamp(x)
    ).cast("date")


def to_number(x) -> Column:
    """Numeric coercion; what is not a number becomes null."""
    return finite(F.expr(f"try_cast(`{x}` AS DOUBLE)") if isinstance(x, str) else x.try_cast("double"))


def total(xs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


# --- sizing rules -------------------------------------------------------------------------


def vol_target_scalar(vol20, n_obs, target: float, max_leverage: float = 1.0) -> Column:
    """min(target / realised vol, leverage cap); 1 for under 5 observations or no usable vol."""
    vol20 = _c(vol20)
    return F.when(
        (_c(n_obs) < 5) | vol20.isNull() | (vol20 == 0), F.lit(1.0)
    ).otherwise(F.least(safe_div(F.lit(target), vol20), F.lit(max_leverage)))


def kelly_fraction(mean, var, cap: float = 0.5) -> Column:
    """clip(mean / variance, 0, cap); 0 when the variance is unusable."""
    return F.coalesce(clip(safe_div(mean, var), 0.0, cap), F.lit(0.0))


def kelly_exposure(mean, var, n_obs, fraction: float = 0.25, max_exposure: float = 1.0) -> Column:
    """Fractional Kelly; the full exposure for under 5 observations or no positive variance."""
    var = _c(var)
    return F.when(
        (_c(n_obs) < 5) | var.isNull() | (var <= 0), F.lit(max_exposure)
    ).otherwise(clip(F.lit(fraction) * safe_div(mean, var), 0.0, max_exposure))


def cash_regime_scalar(breadth200, market_vol, vol_ceiling: float = 0.30) -> Column:
    """Half the breadth score plus half the volatility score, in [0, 1]."""
    breadth = clip(_c(breadth200) / 0.5, 0.0, 1.0)
    vol = clip(F.lit(vol_ceiling) / F.greatest(_c(market_vol), F.lit(1e-6)), 0.0, 1.0)
    return clip(0.5 * breadth + 0.5 * vol, 0.0, 1.0)


def graduated_multiplier(pct100) -> Column:
    """Conviction steps on a 0-100 percentile: under 40, 60, 80 and above."""
    p = _c(pct100)
    return F.when(p < 40, 0.0).when(p < 60, 0.3).when(p < 80, 0.7).when(p.isNotNull(), 1.0)


def turnover_cost(turnover, commission_bps: float, slippage_bps: float) -> Column:
    return _c(turnover) * ((commission_bps + slippage_bps) / 1e4)


def is_microcap(ticker, market_cap, listed: Sequence[str] = ()) -> Column:
    by_size = F.coalesce(_c(market_cap) < MICROCAP_BELOW, F.lit(False))
    return (_c(ticker).isin(*listed) | by_size) if listed else by_size


def promotion_verdict(beats: Column, ic_mean, stability, flags: Column) -> Column:
    """PROMOTE when the bar is passed and no risk flag is up, HOLD when only the benchmark is
    beaten, REJECT otherwise."""
    robust = F.coalesce(_c(stability), F.lit(0.0)) >= 1.0
    passed = beats & (F.abs(_c(ic_mean)) >= 0.02) & robust
    clean = F.size(flags) == 0
    return (
        F.when(passed & clean, "PROMOTE").when(beats & clean, "HOLD").otherwise("REJECT")
    )


def risk_flags(max_drawdown, cost_stress_sharpe, mc_p05) -> Column:
    """Array of the raised flags."""
    checks = [
        (_c(max_drawdown) < -0.30, "drawdown"),
        (_c(cost_stress_sharpe) < 0, "cost_stress"),
        (_c(mc_p05) < -0.25, "mc_p05"),
    ]
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in checks]))
