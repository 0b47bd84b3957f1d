"""Filings and insider flows as point-in-time features."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.windows import series
from .joins import asof_join, calendar_left_join, roll_to_trading_day

c = F.col

CONCEPTS = ["revenue", "shares", "equity", "net_income", "gross_profit", "operating_income", "liabilities", "debt"]
FUNDAMENTAL_COLS = [
    "earnings_yield", "book_to_price", "sales_to_price", "fcf_proxy_yield", "roe", "gross_margin", "op_margin",
    "debt_to_equity", "rev_growth_yoy", "ni_growth_yoy",
]
INSIDER_COLS = ["insider_buy_count_90d", "insider_net_buy_norm"]


def filing_growth(filings: DataFrame) -> DataFrame:
    """Change between consecutive non-null filings of one concept."""
    w = Window.partitionBy("ticker", "concept").orderBy("filed")
    known = filings.where("value IS NOT NULL")
    return known.withColumn("growth", safe_div(c("value"), F.lag("value").over(w)) - 1)


def filings_wide(filings: DataFrame) -> DataFrame:
    """One row per ticker and filing date with a column per concept and the two growth rates."""
    g = filing_growth(filings)
    picks = [F.max(F.when(c("concept") == x, c("value"))).alias(x) for x in CONCEPTS]
    growth = [
        F.max(F.when(c("concept") == x, c("growth"))).alias(n)
        for x, n in (("revenue", "rev_growth_yoy"), ("net_income", "ni_growth_yoy"))
    ]
    return g.groupBy("ticker", "filed").agg(*picks, *growth)


def ratio_columns() -> dict:
    """Ten value, quality and growth ratios from the close and the known filing values."""
    mcap = c("close") * c("shares")
    return {
        "earnings_yield": safe_div(c("net_income"), mcap),
        "book_to_price": safe_div(c("equity"), mcap),
        "sales_to_price": safe_div(c("revenue"), mcap),
        "fcf_proxy_yield": safe_div(c("operating_income"), mcap),
        "roe": safe_div(c("net_income"), c("equity")),
        "gross_margin": safe_div(c("gross_profit"), c("revenue")),
        "op_margin": safe_div(c("operating_income"), c("revenue")),
        "debt_to_equity": safe_div(F.coalesce("debt", "liabilities"), c("equity")),
        "rev_growth_yoy": c("rev_growth_yoy"),
        "ni_growth_yoy": c("ni_growth_yoy"),
    }


def fundamental_ratios(bars: DataFrame, filings: DataFrame) -> DataFrame:
    """The ratios on every bar, from filings public by that date."""
    known = asof_join(bars.select("date", "ticker", "close"), filings_wide(filings))
    return known.select("date", "ticker", *[v.alias(k) for k, v in ratio_columns().items()])


def insider_columns(signed="signed_value", purchases="purchases") -> dict:
    """Purchases over 90 rows, net over 90 per gross over 365; short windows sum what is there."""
    frame = lambda n: series().rowsBetween(-(n - 1), 0)
    return {
        "insider_buy_count_90d": F.sum(purchases).over(frame(90)),
        "insider_net_buy_norm": F.sum(signed).over(frame(90)) / (F.sum(F.abs(signed)).over(frame(365)) + 1.0),
    }


def event_columns(bars: DataFrame, filings: DataFrame | None, insider: DataFrame | None) -> DataFrame:
    """Known filing values and the day's insider flow on every bar, with one exchange for both.

    Filings carry forward; a flow counts on its own date only (0 elsewhere).
    """
    parts = []
    if filings is not None:
        parts.append(filings_wide(filings))
    if insider is not None:
        flow = daily_insider_flow(insider)
        parts.append(flow.select("ticker", c("date").alias("filed"), c("date").alias("_flow_day"), "signed_value", "purchases"))
    if not parts:
        return bars
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p, allowMissingColumns=True)
    out = asof_join(bars, events)
    if insider is not None:
        same = c("_flow_day") == c("date")
        out = out.withColumns({x: F.when(same, c(x)).otherwise(0.0) for x in ("signed_value", "purchases")}).drop("_flow_day")
    return out


def pit_dedupe(facts: DataFrame, priority: Sequence[tuple[str, str]]) -> DataFrame:
    """Company facts to filings: ``(ticker, quantity, filed, value)``.

    ``priority`` lists ``(quantity, concept)`` in order of preference. Per company the most populated
    unit of a concept is used, then the first listed concept that has rows, then per filing date the
    value with the latest period end.
    """
    spark = facts.sparkSession
    order = spark.createDataFrame(
        [(q, k, i) for i, (q, k) in enumerate(priority)], "quantity string, concept string, _prio int")
    rows = facts.where("filed IS NOT NULL AND val IS NOT NULL").join(F.broadcast(order), "concept")
    units = (
        rows.groupBy("ticker", "quantity", "concept", "_prio", "unit").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("ticker", "quantity", "concept", "_prio")
        .agg(F.min_by("unit", F.struct(-c("_n"), c("unit"))).alias("unit"))
        .groupBy("ticker", "quantity")
        .agg(F.min_by(F.struct("concept", "unit"), "_prio").alias("_p"))
        .select("ticker", "quantity", "_p.concept", "_p.unit")
    )
    return (
        rows.join(units, ["ticker", "quantity", "concept", "unit"])
        .groupBy("ticker", "quantity", "filed")
        .agg(F.max_by("val", F.struct("end", "val")).alias("value"))
    )


def daily_insider_flow(tx: DataFrame) -> DataFrame:
    return tx.groupBy("ticker", c("filed").alias("date")).agg(
        F.sum("signed_value").alias("signed_value"), F.sum("is_purchase").cast("double").alias("purchases"))


def insider_features(bars: DataFrame, tx: DataFrame, roll_forward: DataFrame | None = None) -> DataFrame:
    """Purchases over 90 rows, and net value over 90 rows per gross value over 365 rows.

    Short windows sum what is there; a filing on a non-trading day is dropped unless ``roll_forward``
    names the calendar to move it along.
    """
    if roll_forward is not None:
        tx = roll_to_trading_day(tx.withColumnRenamed("filed", "date"), roll_forward).withColumnRenamed("date", "filed")
    flow = daily_insider_flow(tx)
    out = calendar_left_join(bars.select("date", "ticker"), flow, ["date", "ticker"], "zero")
    return out.select("date", "ticker", *[v.alias(k) for k, v in insider_columns().items()])
