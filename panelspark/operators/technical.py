"""Per-ticker time-series features. Each returns levels for :func:`add_features`.

"n days" means n rows of the aligned panel. Every window ends at the current row, so nothing looks
ahead; ``audit.lookahead_probe`` checks that on data.
"""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.windows import (
    Levels, add_features, delay, ewm_levels, gain_recurrence_levels, merge_levels, rolling, series, so_far,
)

c = F.col
ANNUAL = math.sqrt(252)

# Levels are laid out so that windows of one ordering are neighbours and share a sort, and windows of one
# frame share a buffer, however many features are asked for: 0 offsets, 1 arithmetic, 2 rolling, 3 rolling
# over rolling, 4-8 exponential means by block, 9-11 by date again, 12-16 the second exponential mean of
# the directional index, 17-19 the adaptive average.
EWM_AT, AFTER_EWM, KAMA_SUMS_AT = 2, 9, 17


def _at(level: int, levels: Levels) -> Levels:
    return delay(levels, level)


def _ewm(name: str, x: Column, alpha: float, tag: str) -> Levels:
    """Inputs and ordinals at levels 2-3 (by date), block sums at 4-8."""
    return _at(EWM_AT, ewm_levels(name, x, alpha, tag))


def prev() -> dict[str, Column]:
    return {"_pc": F.lag("close").over(series())}


def ret() -> dict[str, Column]:
    return {"_r1": safe_div(c("close"), c("_pc")) - 1}


def tr() -> dict[str, Column]:
    # greatest skips nulls, so the first row falls back to high - low
    return {"_tr": F.greatest(c("high") - c("low"), F.abs(c("high") - c("_pc")), F.abs(c("low") - c("_pc")))}


def momentum(n: int, name: str | None = None) -> Levels:
    return [{name or f"ret_{n}": safe_div(c("close"), F.lag("close", n).over(series())) - 1}]


def log_momentum(n: int) -> Levels:
    return [{f"mom_{n}": F.log("close") - F.log(F.lag("close", n).over(series()))}]


def true_range() -> Levels:
    return [prev(), {"true_range": tr()["_tr"]}]


def _wma(x: Column, n: int) -> Column:
    """Weights 1..n, the newest row weighs n; null while any of the n rows is null."""
    win = F.collect_list(x).over(series().rowsBetween(-(n - 1), 0))
    weighted = F.aggregate(F.transform(win, lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(win) == n, weighted / (n * (n + 1) / 2))


def row_index() -> dict[str, Column]:
    return {"_i": F.row_number().over(series()).cast("double")}


def wma(n: int) -> Levels:
    return _at(2, [{f"wma_{n}": _wma(c("close"), n)}])


def hull_dist(n: int = 20) -> Levels:
    half, root = max(n // 2, 1), max(int(math.sqrt(n)), 1)
    return _at(2, [
        {"_w1": _wma(c("close"), half), "_w2": _wma(c("close"), n)},
        {"_h": _wma(2 * c("_w1") - c("_w2"), root)},
        {"hull_dist": safe_div(c("close") - c("_h"), c("_h"))},
    ])


def adx(n: int = 14) -> Levels:
    up, down = c("high") - c("_ph"), c("_pl") - c("low")
    plus = F.when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when((down > up) & (down > 0), down).otherwise(0.0)
    a = 1 / n
    head: Levels = [
        {**prev(), "_ph": F.lag("high").over(series()), "_pl": F.lag("low").over(series())}, tr(),
    ]
    pdi, mdi = 100 * safe_div(c("_ep"), c("_atr_a")), 100 * safe_div(c("_em"), c("_atr_a"))
    dx = 100 * safe_div(F.abs(pdi - mdi), pdi + mdi)
    x, ordinal, *blocks = ewm_levels("adx", dx, a, "ed")
    return merge_levels(
        head,
        _ewm("_atr_a", c("_tr"), a, "ea"), _ewm("_ep", plus, a, "ep"), _ewm("_em", minus, a, "em"),
        _at(AFTER_EWM, [x, ordinal, {}, *blocks]),
    )


def kama_dist(er: int = 10, fast: int = 2, slow: int = 30) -> Levels:
    """Adaptive moving average: its gain depends only on prices, so the recurrence has a closed form."""
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    ratio = safe_div(F.abs(c("close") - c("_ck")), c("_vol"))
    # no full window yet: volatility is null, the ratio counts as 0 and the gain is the slow one
    gain = F.pow(F.coalesce(ratio, F.lit(0.0)) * (f - s) + s, 2)
    first, decay, block, term, sums, value = gain_recurrence_levels("_kama", c("close"), gain, "k")
    head: Levels = [
        {**prev(), "_ck": F.lag("close", er).over(series())},
        {"_dc": F.abs(c("close") - c("_pc"))},
        {"_vol": rolling(F.sum, "_dc", er), **first},
        decay, block, term,
    ]
    tail = [sums, value, {"kama_dist": safe_div(c("close") - c("_kama"), c("_kama"))}]
    return merge_levels(head, _at(KAMA_SUMS_AT, tail))


def supertrend(n: int = 10, mult: float = 3.0) -> Levels:
    """Direction flips only when the close leaves yesterday's band, so the state is the last event."""
    mid = (c("high") + c("low")) / 2
    event = F.when(c("close") > c("_upp"), 1.0).when(c("close") < c("_lop"), -1.0)
    return merge_levels([prev(), tr()], _ewm("_atr_s", c("_tr"), 1 / n, "es"), _at(AFTER_EWM, [
        {"_up": mid + mult * c("_atr_s"), "_lo": mid - mult * c("_atr_s")},
        {"_upp": F.lag("_up").over(series()), "_lop": F.lag("_lo").over(series())},
        {"supertrend": F.coalesce(F.last(event, ignorenulls=True).over(so_far()), F.lit(1.0))},
    ]))


def trend(n: int = 40) -> Levels:
    """OLS of log price on time: annualised slope and R^2 (0 for a flat price)."""
    frame = series().rowsBetween(-(n - 1), 0)
    x, y = c("_i"), c("_ly")
    sxx = (n * n - 1) / 12.0
    r2 = F.coalesce(safe_div(c("_sxy") * c("_sxy") / sxx, c("_syy")), F.lit(0.0))
    return [
        row_index(),
        {"_ly": F.log("close")},
        {
            "_sxy": F.when(F.count(y).over(frame) == n, F.covar_pop(x, y).over(frame)),
            "_syy": F.var_pop(y).over(frame),
        },
        {"trend_slope": c("_sxy") / sxx * 252, "trend_r2": F.when(c("_sxy").isNotNull(), r2)},
    ]


def rel_volume(n: int = 20) -> Levels:
    return _at(2, [{"rel_volume": safe_div(c("volume"), rolling(F.avg, "volume", n))}])


def obv_z(n: int = 60) -> Levels:
    return [
        prev(),
        {"_sv": F.coalesce(F.signum(c("close") - c("_pc")), F.lit(0.0)) * c("volume")},
        {"_obv": F.sum("_sv").over(so_far())},
        {"_om": rolling(F.avg, "_obv", n), "_os": rolling(F.stddev_samp, "_obv", n)},
        {"obv_z": safe_div(c("_obv") - c("_om"), c("_os"))},
    ]


def cmf(n: int = 20) -> Levels:
    flow = safe_div((c("close") - c("low")) - (c("high") - c("close")), c("high") - c("low")) * c("volume")
    return _at(1, [
        {"_mfv": flow},
        {"cmf": safe_div(rolling(F.sum, "_mfv", n), rolling(F.sum, "volume", n))},
    ])


def vwap_dist(n: int = 20) -> Levels:
    return _at(1, [
        {"_tpv": (c("high") + c("low") + c("close")) / 3 * c("volume")},
        {"_vwap": safe_div(rolling(F.sum, "_tpv", n), rolling(F.sum, "volume", n))},
        {"vwap_dist": safe_div(c("close") - c("_vwap"), c("_vwap"))},
    ])


def vol_accel(n: int = 10) -> Levels:
    return _at(2, [
        {"_mv": rolling(F.avg, "volume", n)},
        {"vol_accel": safe_div(c("_mv"), F.lag("_mv", n).over(series())) - 1},
    ])


def atr_pct(n: int = 14) -> Levels:
    return merge_levels([prev(), tr()], _ewm("_atr_a", c("_tr"), 1 / n, "ea"), _at(AFTER_EWM, [
        {"atr_pct": safe_div(c("_atr_a"), c("close"))}
    ]))


def realized_vol(n: int) -> Levels:
    return [prev(), ret(), {f"realized_vol_{n}": rolling(F.stddev_samp, "_r1", n) * ANNUAL}]


def vol_of_vol(n: int = 20) -> Levels:
    return [
        prev(), ret(), {f"_sd{n}": rolling(F.stddev_samp, "_r1", n)},
        {"vol_of_vol": rolling(F.stddev_samp, f"_sd{n}", n) * ANNUAL},
    ]


def parkinson_vol(n: int = 20) -> Levels:
    return _at(1, [
        {"_hl2": F.pow(F.log(safe_div(c("high"), c("low"))), 2)},
        {"parkinson_vol": F.sqrt(rolling(F.avg, "_hl2", n) / (4 * math.log(2)) * 252)},
    ])


def yang_zhang_vol(n: int = 20) -> Levels:
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    ho, lo, co = (F.log(safe_div(c(x), c("open"))) for x in ("high", "low", "close"))
    return [
        prev(),
        {
            "_rs": ho * (ho - co) + lo * (lo - co),
            "_oc": F.log(safe_div(c("open"), c("_pc"))),
            "_cc": F.log(safe_div(c("close"), c("_pc"))),
        },
        {
            "yang_zhang_vol": F.sqrt(252 * (
                rolling(F.var_samp, "_oc", n) + k * rolling(F.var_samp, "_cc", n) + (1 - k) * rolling(F.avg, "_rs", n)
            ))
        },
    ]


def bollinger_z(n: int = 20, name: str = "boll_z") -> Levels:
    return _at(2, [{name: safe_div(c("close") - rolling(F.avg, "close", n), rolling(F.stddev_samp, "close", n))}])


def ema_dist(span: int = 20) -> Levels:
    return merge_levels(_ewm("_ema", c("close"), 2 / (span + 1), "ee"), _at(AFTER_EWM, [
        {"ema_dist": safe_div(c("close") - c("_ema"), c("_ema"))}
    ]))


def pct_rank(n: int = 60, name: str = "pct_rank_60") -> Levels:
    """Share of the last n closes strictly below the current one."""
    frame = series().rowsBetween(-(n - 1), 0)
    below = F.size(F.filter("_win", lambda y: y < c("close")))
    return _at(2, [
        {"_win": F.collect_list("close").over(frame)},
        {name: F.when(F.size("_win") == n, below / F.lit(float(n)))},
    ])


def rsi(n: int = 14) -> Levels:
    change = c("close") - c("_pc")
    gain = F.when(change.isNotNull(), F.greatest(change, F.lit(0.0)))
    loss = F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))
    return merge_levels([prev()], _ewm("_gain", gain, 1 / n, "eg"), _ewm("_loss", loss, 1 / n, "el"), _at(AFTER_EWM, [
        {"rsi": 100 - 100 / (1 + safe_div(c("_gain"), c("_loss")))}
    ]))


def single_name_features(
    momentum_windows: Sequence[int] = (5, 10, 20, 40, 60, 120), vol_windows: Sequence[int] = (10, 20, 60),
) -> list[Levels]:
    """The single-name block of the panel (28 columns at the defaults)."""
    return (
        [log_momentum(w) for w in momentum_windows]
        + [adx(), kama_dist(), hull_dist(), supertrend(), trend(), rel_volume(), obv_z(), cmf(), vwap_dist(), vol_accel()]
        + [realized_vol(w) for w in vol_windows]
        + [atr_pct(), parkinson_vol(), yang_zhang_vol(), vol_of_vol(), bollinger_z(), ema_dist(), pct_rank(), rsi()]
    )


def technical_features(bars: DataFrame, features: Sequence[Levels] | None = None) -> DataFrame:
    return add_features(bars, features if features is not None else single_name_features())
