"""Bar tables: scan, write, calendar alignment, reshaping."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ["open", "high", "low", "close", "volume"]


def read_bars(spark: SparkSession, path: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """Long OHLCV scan; year partitions and the ticker filter prune at the source."""
    df = spark.read.parquet(path)
    return df.where(F.col("ticker").isin(*tickers)) if tickers else df


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write partitioned by year.

    Rows are first spread by year and a hash of the ticker, so a year is written by several tasks (one
    file each) however unevenly the rows fall over years.
    """
    (
        df.withColumn("year", F.year("date"))
        .withColumn("_slot", F.pmod(F.hash("ticker"), F.lit(16)))
        .repartition("year", "_slot")
        .drop("_slot")
        .write.mode(mode).partitionBy("year").parquet(path)
    )


def calendar(dates: DataFrame) -> DataFrame:
    """Distinct dates with a dense position from 0.

    The one ordered window without partitions in the library: it sees distinct trading days only
    (about 250 a year), never rows of the panel.
    """
    return dates.select("date").distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("pos"))


def align_bars(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """One row per calendar date and ticker from the ticker's first bar on, gaps filled forward.

    Every bar is repeated up to the day before the next one, so no dates-by-tickers grid is built and
    joined: the work equals the rows that come out. ``pos`` is the calendar position.
    """
    values = [c for c in bars.columns if c not in ("date", "ticker")]
    w = Window.partitionBy("ticker").orderBy("pos")
    last = cal.agg(F.max("pos")).scalar()
    runs = bars.join(cal, "date").select(
        "ticker", *values, "pos",
        F.coalesce(F.lead("pos").over(w) - 1, last).alias("_until"),
    )
    return (
        runs.select("ticker", *values, F.explode(F.sequence("pos", "_until")).alias("pos"))
        .join(cal, "pos")
        .select("date", "pos", "ticker", *values)
    )


def slice_universe(bars: DataFrame, tickers: DataFrame | Sequence[str]) -> DataFrame:
    """Keep the requested tickers that exist."""
    if isinstance(tickers, DataFrame):
        return bars.join(tickers.select("ticker"), "ticker", "left_semi")
    return bars.where(F.col("ticker").isin(*tickers))


def wide_to_long(wide: DataFrame, value: str = "close") -> DataFrame:
    names = [c for c in wide.columns if c != "date"]
    return wide.unpivot(["date"], names, "ticker", value).where(F.col(value).isNotNull())


def long_to_wide(bars: DataFrame, value: str = "close", tickers: Sequence[str] | None = None) -> DataFrame:
    """One column per ticker; for the edge of a job only. Pass ``tickers`` to skip the distinct scan."""
    g = bars.groupBy("date")
    return (g.pivot("ticker", list(tickers)) if tickers else g.pivot("ticker")).agg(F.first(value))


def union_calendar(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("date")
    for f in frames[1:]:
        out = out.union(f.select("date"))
    return out.distinct()


def union_tickers(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("ticker")
    for f in frames[1:]:
        out = out.union(f.select("ticker"))
    return out.distinct()


def concat_panels(books: Sequence[DataFrame]) -> DataFrame:
    """Union of several books' bars; on a clash of ``(date, ticker)`` the earlier book wins.

    ``min_by`` on the book number combines before the shuffle, no sort of the union is needed.
    """
    cols = books[0].columns
    tagged = books[0].withColumn("_prio", F.lit(0))
    for i, b in enumerate(books[1:], 1):
        tagged = tagged.unionByName(b.select(*cols).withColumn("_prio", F.lit(i)))
    rest = [c for c in cols if c not in ("date", "ticker")]
    picked = tagged.groupBy("date", "ticker").agg(F.min_by(F.struct(*rest), "_prio").alias("_r"))
    return picked.select("date", "ticker", "_r.*")
