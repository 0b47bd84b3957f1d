"""Append-only decision ledger: JSON lines in, parquet out."""
from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col

DECISION = ("struct<asset:string,action:string,ev_score:double,risk_status:string,confidence:double,"
            "target_weight:double,reasoning:string,sources:string>")
LEDGER_SCHEMA = (f"date date, sleeve string, status string, n_positions int, day_return double, "
                 f"decisions array<{DECISION}>")

#: fixed values: canonical order of the sleeves in reports, the market first
SLEEVE_ORDER = [
    "market_spy", "equity_validated", "equity_full_goal", "crypto_full_goal", "full_system", "full_system_max",
    "metals_full_goal", "full_system_v6", "bonds_full_goal",
]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).json(path)


def with_positions(rows: DataFrame) -> DataFrame:
    """``n_positions`` = decisions with a positive target."""
    return rows.withColumn("n_positions", F.size(F.filter("decisions", lambda d: d["target_weight"] > 0)))


def append_ledger(rows: DataFrame, path: str) -> None:
    with_positions(rows).write.mode("append").parquet(path)


def append_if_newer(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows newer than the last logged date of their sleeve; one row per sleeve and date.

    The last dates are one row per sleeve. A re-run of the same day yields nothing.
    """
    last = ledger.groupBy("sleeve").agg(F.max("date").alias("_last"))
    fresh = rows.join(last, "sleeve", "left").where(c("_last").isNull() | (c("date") > c("_last"))).drop("_last")
    return fresh.dropDuplicates(["sleeve", "date"])


def flatten_decisions(ledger: DataFrame) -> DataFrame:
    return ledger.select("date", "sleeve", F.inline("decisions"))


def parse_ledger_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.select(F.from_json(col, LEDGER_SCHEMA).alias("_r")).select("_r.*")


def refresh_if_nonempty(new: DataFrame, dest: str) -> bool:
    """Publish a new snapshot only when it has rows; read it with :func:`read_snapshot`.

    The rows go to a folder of their own, and one pointer row makes them current. A job that fails before that
    row leaves the snapshot before it in place, and readers never see half of one.
    """
    spark, version = new.sparkSession, time.time_ns()
    data = f"{dest.rstrip('/')}/data/{version}-{uuid.uuid4().hex}"
    new.write.parquet(data)
    if spark.read.schema(new.schema).parquet(data).isEmpty():
        return False
    pointer = spark.createDataFrame([(version, data)], "version long, path string").coalesce(1)
    pointer.write.mode("append").parquet(f"{dest.rstrip('/')}/pointers")
    return True


def read_snapshot(spark: SparkSession, dest: str) -> DataFrame:
    """The snapshot that the newest pointer names."""
    newest = spark.read.parquet(f"{dest.rstrip('/')}/pointers").agg(F.max_by("path", "version")).first()[0]
    return spark.read.parquet(newest)


def sleeve_position(sleeve="sleeve"):
    """Place in the canonical order, unknown sleeves last."""
    from ..functions.columns import first_match
    return first_match([(c(sleeve) == n, i) for i, n in enumerate(SLEEVE_ORDER)], 99)


def export_csv(df: DataFrame, path: str) -> None:
    """Ordered report table; one row per sleeve, hence a single file."""
    df.orderBy(sleeve_position(), "sleeve").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_daily_returns(ledger: DataFrame, path: str) -> None:
    rows = ledger.where("day_return IS NOT NULL").select("date", "sleeve", "day_return")
    rows.orderBy("date", sleeve_position(), "sleeve").write.mode("overwrite").option("header", True).csv(path)


def scoreboard_order(standings: DataFrame) -> DataFrame:
    w = Window.orderBy(sleeve_position(), c("sleeve"))
    return standings.withColumn("place", F.row_number().over(w))
