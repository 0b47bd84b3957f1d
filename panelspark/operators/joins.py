"""Point-in-time joins."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def asof_join(panel: DataFrame, events: DataFrame, by: Sequence[str] = ("ticker",), left_on: str = "date",
              right_on: str = "filed", values: Sequence[str] | None = None) -> DataFrame:
    """Backward as-of join: each panel row sees, per value column, the last non-null event value at or
    before its date.

    Both sides are stacked, events before panel rows on the same day, and the last value is carried
    forward: one exchange and one sort on the keys, no range comparison of pairs.
    """
    keys = list(by)
    values = list(values or [x for x in events.columns if x not in (*keys, right_on)])
    left = panel.withColumns({"_t": c(left_on), "_side": F.lit(1)})
    right = events.select(*keys, c(right_on).alias("_t"), F.lit(0).alias("_side"), *values)
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return (
        both.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values})
        .where(c("_side") == 1)
        .drop("_t", "_side")
    )


def asof_lookup(prices: DataFrame, points: DataFrame, on: str = "point_date") -> DataFrame:
    """Last close at or before each ``(ticker, point_date)``."""
    return asof_join(points, prices.select("ticker", "date", c("close").alias("price")), ["ticker"], on, "date", ["price"])


def interval_join(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows whose ticker was a member on that date; several windows of a ticker are OR-ed.

    The equality on the ticker keeps it a hash join; the semi join emits a row once.
    """
    m = membership.select(c("ticker").alias("_m"), c("start").alias("_s"), c("end").alias("_e"))
    inside = (
        (c("ticker") == c("_m"))
        & (c("date") >= F.coalesce(c("_s"), c("date")))
        & (c("date") <= F.coalesce(c("_e"), c("date")))
    )
    return panel.join(m, inside, "left_semi")


def with_membership(panel: DataFrame, membership: DataFrame, flag: str = "member") -> DataFrame:
    """The same test as a column: a ticker's few windows travel as one array, so rows are neither
    dropped nor joined by range."""
    spells = membership.groupBy(c("ticker")).agg(F.collect_list(F.struct("start", "end")).alias("_spells"))
    inside = F.exists("_spells", lambda w: (c("date") >= F.coalesce(w["start"], c("date"))) & (c("date") <= F.coalesce(w["end"], c("date"))))
    return panel.join(spells, "ticker", "left").withColumn(flag, F.coalesce(inside, F.lit(False))).drop("_spells")


def submission_join(submissions: DataFrame, transactions: DataFrame, universe: DataFrame) -> DataFrame:
    """Open-market transactions of the universe's filings.

    The universe and the codes cut both sides before they meet on the accession number.
    """
    from ..functions.columns import clean_symbol, parse_filing_date, to_number
    subs = submissions.select(
        "ACCESSION_NUMBER", clean_symbol("ISSUERTRADINGSYMBOL").alias("ticker"),
        parse_filing_date("FILING_DATE").alias("filed"),
    ).join(universe.select("ticker"), "ticker", "left_semi").where("filed IS NOT NULL")
    from ..sources.filings import open_market_only
    value = F.coalesce(to_number("TRANS_SHARES"), F.lit(0.0)) * F.coalesce(to_number("TRANS_PRICEPERSHARE"), F.lit(0.0))
    buy = c("TRANS_CODE") == "P"
    return (
        open_market_only(transactions).join(subs, "ACCESSION_NUMBER")
        .select("ticker", "filed", F.when(buy, value).otherwise(-value).alias("signed_value"),
                buy.cast("int").alias("is_purchase"))
    )


def sector_join(panel: DataFrame, sectors: DataFrame, default: str = "Other") -> DataFrame:
    """Left join of the sector dimension; the optimizer broadcasts it while its size permits."""
    return panel.join(sectors.select("ticker", c("sector").alias("_sec")), "ticker", "left").withColumn(
        "sector", F.coalesce("_sec", F.lit(default))).drop("_sec")


def roll_to_trading_day(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Move each event's ``date`` to the next trading day; events after the last one are dropped.

    Only distinct days are ordered, so the single ordered window is bounded by the calendar.
    """
    w = Window.orderBy(c("_o").desc(), c("_asked"))
    marks = calendar.select(c("date").alias("_o"), F.lit(0).alias("_asked"), c("date").alias("_d")).unionByName(
        events.select("date").distinct().select(
            c("date").alias("_o"), F.lit(1).alias("_asked"), F.lit(None).cast("date").alias("_d")))
    moved = marks.withColumn("_next", F.last("_d", ignorenulls=True).over(w)).where("_asked = 1 AND _next IS NOT NULL")
    return events.join(moved.select(c("_o").alias("date"), "_next"), "date").drop("date").withColumnRenamed("_next", "date")


def calendar_left_join(panel: DataFrame, series: DataFrame, on: Sequence[str], fill: str | None = None) -> DataFrame:
    """Exact-date left join: an observation on a non-trading day is dropped.

    ``fill``: ``None``, ``"zero"`` or ``"forward"``. To keep observations on other days, move them first
    with :func:`roll_to_trading_day`.
    """
    values = [x for x in series.columns if x not in on]
    out = panel.join(series, list(on), "left")
    if fill == "zero":
        return out.withColumns({v: F.coalesce(c(v), F.lit(0.0)) for v in values})
    if fill == "forward":
        keys = [k for k in on if k != "date"]
        carried = lambda w: {v: F.last(v, ignorenulls=True).over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) for v in values}
        if keys:
            return out.withColumns(carried(Window.partitionBy(*keys)))
        # a market-wide series is carried along the distinct dates, one row each, and then joined to the panel
        days = panel.select("date").distinct().join(series, "date", "left").withColumns(carried(Window.partitionBy(F.lit(0))))
        return panel.join(days, "date", "left")
    return out


def weight_delta_join(weights: DataFrame) -> DataFrame:
    """Old and new weight of every name per rebalance, missing = 0.

    ``weights(strategy, rebal_no, ticker, weight)``; the previous rebalance is the same table one
    number on, so a position that is closed shows up with new weight 0. The last book has no
    successor and yields no closing rows.
    """
    last = F.max("rebal_no").over(Window.partitionBy("strategy"))  # a join on the strategy alone could become a product
    old = (
        weights.withColumn("_last", last).where(c("rebal_no") < c("_last"))
        .select("strategy", (c("rebal_no") + 1).alias("rebal_no"), "ticker", c("weight").alias("old_w"))
    )
    new = weights.select("strategy", "rebal_no", "ticker", c("weight").alias("new_w"))
    return new.join(old, ["strategy", "rebal_no", "ticker"], "full_outer").withColumns(
        {"old_w": F.coalesce("old_w", F.lit(0.0)), "new_w": F.coalesce("new_w", F.lit(0.0))})


def score_target_join(scores: DataFrame, target: DataFrame) -> DataFrame:
    return scores.join(target, ["date", "ticker"]).where("score IS NOT NULL AND target IS NOT NULL")


def latest_per_key(ledger: DataFrame, key: str = "sleeve") -> DataFrame:
    """Last logged row per sleeve with its positive targets only."""
    last = ledger.groupBy(key).agg(F.max_by(F.struct("date", "decisions"), "date").alias("_r"))
    return last.select(key, c("_r.date").alias("date"),
                       F.filter("_r.decisions", lambda d: d["target_weight"] > 0).alias("decisions"))


def pair_folds(base: DataFrame, full: DataFrame) -> DataFrame:
    return base.select("fold", c("ic").alias("base")).join(full.select("fold", c("ic").alias("full")), "fold").where(
        "base IS NOT NULL AND full IS NOT NULL")
