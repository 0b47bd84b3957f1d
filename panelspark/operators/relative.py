"""Names against reference series, and market-wide state."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.windows import add_features, rolling, series

c = F.col


def market_join(panel: DataFrame, by_date: DataFrame) -> DataFrame:
    """One row per date onto all tickers.

    The right side has one row per trading day, a few thousand, whatever the number of tickers: a
    broadcast with a fixed bound.
    """
    return panel.join(F.broadcast(by_date), "date", "left")


def relative_strength(panel: DataFrame, refs: DataFrame, n: int = 60) -> DataFrame:
    """Change over n rows of the ratio to each reference, one row per reference.

    ``refs(date, ref, close)`` must be filled over the calendar. A date's references are one packed map; a row
    looks its own date and the date n rows back up in it, so names and references only meet in the output.
    """
    w = series()
    packed = refs.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("ref", "close"))).alias("_refs"))  # one row per trading day
    rows = panel.select("date", "ticker", "close", F.lag("close", n).over(w).alias("_old"), F.lag("date", n).over(w).alias("_day"))
    rows = market_join(rows, packed).join(F.broadcast(packed.select(c("date").alias("_day"), c("_refs").alias("_then"))), "_day", "left")
    each = rows.select("date", "ticker", "close", "_old", "_then", F.explode("_refs").alias("ref", "_now"))
    old = safe_div(c("_old"), F.try_element_at("_then", c("ref")))
    return each.select("date", "ticker", "ref", (safe_div(safe_div(c("close"), c("_now")), old) - 1).alias("rs"))


def relative_strength_column(name: str, ref_col: str, n: int = 60):
    """The same as a panel column when the reference close is already joined."""
    q = f"_q_{name}"
    return [
        {q: safe_div(c("close"), c(ref_col))},
        {name: safe_div(c(q), F.lag(q, n).over(series())) - 1},
    ]


def rolling_beta_levels(name: str = "beta", ref_col: str = "_bench", n: int = 60):
    frame = series().rowsBetween(-(n - 1), 0)
    both = c("_br").isNotNull() & c("_bm").isNotNull()
    x, y = F.when(both, c("_br")), F.when(both, c("_bm"))
    return [
        {
            "_br": safe_div(c("close"), F.lag("close").over(series())) - 1,
            "_bm": safe_div(c(ref_col), F.lag(ref_col).over(series())) - 1,
        },
        {},
        {
            name: F.when(
                F.count(x).over(frame) == n,
                safe_div(F.covar_samp(x, y).over(frame), rolling(F.var_samp, "_bm", n)),
            )
        },
    ]


def rolling_beta(panel: DataFrame, bench: DataFrame, n: int = 60) -> DataFrame:
    joined = market_join(panel, bench.select("date", c("close").alias("_bench")))
    return add_features(joined, [rolling_beta_levels("beta", "_bench", n)]).drop("_bench")


def breadth_flags(mas: Sequence[int] = (20, 50, 200), highs: int = 252):
    """Per-name conditions; a name in warm-up counts as false."""
    flags = {f"_is_breadth_pct_above_{n}": c("close") > rolling(F.avg, "close", n) for n in mas}
    flags["_is_breadth_new_highs"] = c("close") >= rolling(F.max, "close", highs)
    flags["_is_breadth_new_lows"] = c("close") <= rolling(F.min, "close", highs)
    return [{}, {}, {k: F.coalesce(v, F.lit(False)).cast("double") for k, v in flags.items()}]


def breadth(bars: DataFrame, mas: Sequence[int] = (20, 50, 200), highs: int = 252) -> DataFrame:
    """Per date: share of *all* names above their own n-row mean, at their n-row high, at their low.

    A name that has not started yet still counts in the denominator. The sum over names combines on the
    map side.
    """
    level = breadth_flags(mas, highs)[2]
    names = bars.agg(F.countDistinct("ticker")).scalar()
    outs = [k[4:] for k in level]
    sums = bars.withColumns(level).groupBy("date").agg(*[F.sum(f"_is_{k}").alias(k) for k in outs])
    return sums.select("date", *[(c(k) / names).alias(k) for k in outs])


def mature_breadth(bars: DataFrame, n: int = 200) -> DataFrame:
    """Per date: share of the names with ``n`` closes that are above their own n-row mean; null without such a name."""
    above = c("close") > rolling(F.avg, "close", n)  # unknown, and so left out, before n closes
    return bars.withColumn("_above", above.cast("double")).groupBy("date").agg(F.avg("_above").alias("breadth"))
