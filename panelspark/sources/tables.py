"""Panel inputs derived from the order tables (``lineitem orders part region events``).

Each function is one declarative job; nothing here depends on the size of the input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import align_bars, calendar

ORDER_TABLES = "region nation customer supplier part orders lineitem events documents".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trades ``(date, ticker, price, qty, seq)``; ``seq`` orders trades in a day.

    The join key may be skewed (one hot part); adaptive execution splits such partitions, and the
    per-day aggregate that follows combines on the map side.
    """
    li = table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        "l_partkey",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        (
            (F.col("l_orderkey").cast("decimal(19,0)") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
            * F.lit(10**12).cast("decimal(13,0)")
            + F.col("l_partkey").cast("decimal(19,0)")
        ).alias("seq"),
    )
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"), "p_type")
    return li.join(part, "l_partkey")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily OHLCV per brand; first and last trade of the day by order key."""
    return trades(spark, folder).groupBy("date", "ticker").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    )


def trading_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct trading days with their position; a one-column scan."""
    return calendar(table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date")))


def bars_filled(spark: SparkSession, folder: str) -> DataFrame:
    return align_bars(bars(spark, folder), trading_calendar(spark, folder))


def price_level(filled: DataFrame) -> DataFrame:
    """Equal-weight price level of all names of aligned bars: one row per date."""
    return filled.groupBy("date", "pos").agg(F.avg("close").alias("close"))


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return price_level(bars_filled(spark, folder))


def references(spark: SparkSession, folder: str) -> DataFrame:
    """One reference close series per part type, filled over the calendar."""
    closes = (
        trades(spark, folder)
        .groupBy("date", F.col("p_type").alias("ticker"))
        .agg(F.max_by("price", "seq").alias("close"))
    )
    return align_bars(closes, trading_calendar(spark, folder)).withColumnRenamed("ticker", "ref")


def brand_number(brand="ticker"):
    return F.regexp_extract(brand, r"(\d+)", 1).cast("int")


def tickers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_brand").alias("ticker")).distinct()


def n_names(spark: SparkSession, folder: str) -> int:
    """Number of tickers, which bounds the names of a date; a one-column scan of a dimension."""
    return tickers(spark, folder).count()


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("sector"))
    return (
        tickers(spark, folder)
        .withColumn("r_regionkey", brand_number() % 5)
        .join(region, "r_regionkey", "left")
        .select("ticker", "sector")
    )


def membership(spark: SparkSession, folder: str) -> DataFrame:
    """Membership windows: odd brands open, even ones closed, multiples of four with a second window."""
    n = brand_number()
    window = "struct<start:date,end:date>"
    first = F.struct(
        F.lit("1995-01-01").cast("date").alias("start"),
        F.when(n % 2 == 0, F.lit("1999-12-31").cast("date")).alias("end"),
    ).cast(window)
    second = F.struct(
        F.lit("2000-07-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end")
    ).cast(window)
    return (
        tickers(spark, folder)
        .withColumn("w", F.explode(F.when(n % 4 == 0, F.array(first, second)).otherwise(F.array(first))))
        .select("ticker", "w.start", "w.end")
    )


def filings(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly filings per brand, long ``(ticker, filed, concept, value)``.

    Debt is reported by every third brand only, so the liabilities fallback is exercised.
    """
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("od"), "o_totalprice")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    wide = (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("ticker", F.date_trunc("quarter", "od").alias("q"))
        .agg(
            F.max("od").alias("filed"),
            F.sum(net).alias("revenue"),
            F.sum("l_quantity").alias("shares"),
            F.sum("o_totalprice").alias("equity"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("net_income"),
            F.sum(F.when(F.col("l_tax") > 0.03, net).otherwise(0.0)).alias("gross_profit"),
            F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("operating_income"),
            F.sum(F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")).otherwise(0.0)).alias("liabilities"),
        )
        .withColumn("debt", F.when(brand_number() % 3 == 0, F.col("liabilities") / 2))
    )
    concepts = ["revenue", "shares", "equity", "net_income", "gross_profit", "operating_income", "liabilities", "debt"]
    return wide.unpivot(["ticker", "filed"], concepts, "concept", "value").where("value IS NOT NULL")


def insider_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines as open-market transactions: A = purchase, R = sale, N is no transaction."""
    li = (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag").isin("A", "R"))
        .select("l_partkey", F.to_date("l_shipdate").alias("filed"), "l_returnflag",
                (F.col("l_quantity") * F.col("l_extendedprice") * F.col("l_discount")).alias("v"))
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    buy = F.col("l_returnflag") == "A"
    return li.join(part, "l_partkey").select(
        "ticker", "filed",
        F.when(buy, F.col("v")).otherwise(-F.col("v")).alias("signed_value"),
        buy.cast("int").alias("is_purchase"),
    )


def macro(spark: SparkSession, folder: str) -> DataFrame:
    """Two macro series per order date; the second prints on Fridays only."""
    day = F.to_date("o_orderdate")
    return (
        table(spark, folder, "orders")
        .groupBy(day.alias("date"))
        .agg(
            F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0)).alias("T10Y2Y"),
            (F.avg("o_totalprice") / 250000 - 1).alias("_n"),
        )
        .select("date", "T10Y2Y", F.when(F.dayofweek("date") == 6, F.col("_n")).alias("NFCI"))
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Event days as ledger rows of nine sleeves with one decision per event type.

    Two aggregates over the events: per type (small after combining), then per sleeve and day. The
    decision array holds one entry per event type, so it stays short however many events there are.
    """
    by_type = (
        table(spark, folder, "events")
        .groupBy(
            F.to_date("ts").alias("date"),
            F.concat(F.lit("sleeve_"), F.pmod(F.col("user_id"), F.lit(9)).cast("string")).alias("sleeve"),
            "event_type",
        )
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    )
    decisions = F.transform(
        F.array_sort(F.collect_list(F.struct("event_type", "n"))),
        lambda d: F.struct(
            d["event_type"].alias("asset"), F.lit("BUY").alias("action"),
            d["n"].cast("double").alias("target_weight"),
        ),
    )
    total_n = F.sum("n")
    return (
        by_type.groupBy("date", "sleeve")
        .agg((F.sum("s") / total_n).alias("mean"), total_n.alias("n"), decisions.alias("raw"))
        .select(
            "date", "sleeve", F.lit("shadow").alias("status"),
            F.size("raw").alias("n_positions"),
            ((F.col("mean") - 50) / 1000).alias("day_return"),
            F.transform("raw", lambda d: F.struct(
                d["asset"].alias("asset"), d["action"].alias("action"),
                (d["target_weight"] / F.col("n") / 2).alias("target_weight"),
            )).alias("decisions"),
        )
    )


def returns(spark: SparkSession, folder: str, scale: float = 1.0) -> DataFrame:
    """Daily change of every name as a strategy return series ``(strategy, date, ret)``."""
    w = Window.partitionBy("ticker").orderBy("date")
    return (
        bars_filled(spark, folder)
        .select(F.col("ticker").alias("strategy"), "date",
                (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("r"))
        .where("r IS NOT NULL")
        .select("strategy", "date", (F.col("r") / scale).alias("ret"))
    )


def filing_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A simple score panel used by evaluation operators: 20-day log momentum."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars_filled(spark, folder).select(
        "date", "pos", "ticker", "close", "volume",
        (F.log("close") - F.log(F.lag("close", 20).over(w))).alias("score"),
    )
