"""The daily ledger as a stream: append, risk state, change alarms, standings, weekly rollup.

Sinks are folders below the shared folder; every batch writes its own sub-folder, so a batch that is
retried after a lost executor or driver overwrites itself instead of adding rows twice.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.governance import GovernorMemory, governor_path
from ..operators.monitor import PH_DELTA, PH_LAMBDA
from ..sources.ledger import LEDGER_SCHEMA

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state on local disk with changelog in the checkpoint; needed by the stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ledger_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LEDGER_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).withColumn("ts", c("date").cast("timestamp"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, one folder per batch, then stop."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(write).start().awaitTermination()


class AppendProcessor(StatefulProcessor):
    """Which rows of a sleeve are news: the last date of earlier batches, and the dates seen, which expire by the
    ledger's own dates, so a replay decides alike.

    A date seen before is a re-sent row and goes; one at or before the last date of earlier batches that was never
    seen is late and is kept apart; everything else is new.
    """

    def __init__(self, ttl_days: int):
        self.ttl_days = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "date string")
        self.seen = handle.getMapState("seen", "date string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = newest = self.last.get()[0] if self.last.exists() else ""
        for batch in rows:
            batch = batch.assign(date=batch["date"].astype(str))
            kinds = []
            for date in batch["date"]:
                if self.seen.containsKey((date,)):
                    kinds.append(None)
                    continue
                self.seen.updateValue((date,), (1,))
                kinds.append("new" if date > last else "late")
                newest = max(newest, date)
            out = batch.assign(kind=kinds)
            yield out[out["kind"].notna()]
        self.last.update((newest,))
        oldest = str(pd.Timestamp(newest).date() - pd.Timedelta(days=self.ttl_days))
        for (date,) in [k for k in self.seen.keys() if k[0] < oldest]:
            self.seen.removeKey((date,))

    def close(self) -> None:
        pass


_APPENDED = "sleeve string, date string, status string, n_positions int, day_return double, decisions string, kind string"


def stream_ledger_append(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int | None = None, ttl_days: int = 30) -> None:
    """New ledger rows into the table; re-sent rows and re-run days never duplicate, late rows are kept apart.

    What decides is keyed state (one date per sleeve, and the dates of its last ``ttl_days``), so the table is
    never read back. Every batch overwrites its own folder; read with :func:`read_appended`.
    """
    rows = ledger_stream(spark, folder, files_per_batch).drop("ts").where("date IS NOT NULL")
    flat = rows.select("sleeve", "date", "status", "n_positions", "day_return", F.to_json("decisions").alias("decisions"))
    judged = flat.groupBy("sleeve").transformWithStateInPandas(
        statefulProcessor=AppendProcessor(ttl_days), outputStructType=T.StructType.fromDDL(_APPENDED), outputMode="Append", timeMode="None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{table}/batch={batch_id}")

    judged.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        write).start().awaitTermination()


def read_appended(spark: SparkSession, table: str, kind: str = "new") -> DataFrame:
    """Rows of the table: ``new`` ones, which are the ledger, or the ``late`` ones beside it."""
    schema = T.StructType.fromDDL(f"{_APPENDED}, batch long")
    rows = spark.read.schema(schema).parquet(table).where(c("kind") == kind)
    decisions = T.StructType.fromDDL(LEDGER_SCHEMA)["decisions"].dataType
    return rows.select(c("date").cast("date").alias("date"), "sleeve", "status", "n_positions", "day_return", F.from_json("decisions", decisions).alias("decisions"), "batch")


def _in_order(rows: Iterator[pd.DataFrame], last: str) -> tuple[pd.DataFrame, int]:
    """Rows of a batch after the last seen date, by date, one a day, and how many came too late."""
    batch = pd.concat(list(rows)).sort_values("date")
    batch["date"] = batch["date"].astype(str)
    fresh = batch[batch["date"] > last].drop_duplicates("date")
    return fresh, len(batch) - len(fresh)


class GovernorProcessor(StatefulProcessor):
    """Risk state of one sleeve; a row at or before the last seen date is late, counted and skipped."""

    FIELDS = "nav double, peak double, n long, gain long, hit long, down boolean, last string, late long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("governor", self.FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *memory, last, late = self.state.get() if self.state.exists() else (*GovernorMemory(), "", 0)
        memory = GovernorMemory(*memory)
        fresh, skipped = _in_order(rows, last)
        held = fresh["day_return"].notna().to_numpy()
        states, after = governor_path(fresh["day_return"].to_numpy(float)[held], memory)
        # the state before a row is the one after the last return before it
        before = [memory.state(), *states]
        reason = [before[k] for k in np.cumsum(held) - held]
        late += skipped
        self.state.update((*after, fresh["date"].iloc[-1] if len(fresh) else last, late))
        yield pd.DataFrame({"sleeve": key[0], "date": fresh["date"], "exposure": [float(r == "ok") for r in reason], "reason": reason, "late": late})

    def close(self) -> None:
        pass


class PageHinkleyProcessor(StatefulProcessor):
    """Change alarm of one sleeve: the windows of the batch form continued from their last values."""

    FIELDS = "n long, total double, up double, down double, low double, high double, alarm boolean, last string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("page_hinkley", self.FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        past = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, np.inf, -np.inf, False, "")
        n, total, up, down, low, high, alarm, last = past
        fresh, _ = _in_order((r.dropna(subset=["day_return"]) for r in rows), last)
        if not len(fresh):
            return
        x = fresh["day_return"].to_numpy(float)
        place, sums = n + np.arange(1, len(x) + 1), total + np.cumsum(x)
        ups = up + np.cumsum(x - sums / place - PH_DELTA)
        downs = down + np.cumsum(x - sums / place + PH_DELTA)
        lows, highs = np.minimum(np.minimum.accumulate(ups), low), np.maximum(np.maximum.accumulate(downs), high)
        rise, fall = ups - lows, highs - downs
        alarms = np.logical_or.accumulate((rise > PH_LAMBDA) | (fall > PH_LAMBDA)) | alarm
        self.state.update((int(place[-1]), *(float(a[-1]) for a in (sums, ups, downs, lows, highs)), bool(alarms[-1]), fresh["date"].iloc[-1]))
        yield pd.DataFrame({"sleeve": key[0], "date": fresh["date"], "rise": rise, "fall": fall, "alarm": alarms})

    def close(self) -> None:
        pass


_TEXT, _NUM = T.StringType(), T.DoubleType()
GOVERNOR_OUT = T.StructType([T.StructField("sleeve", _TEXT), T.StructField("date", _TEXT), T.StructField("exposure", _NUM),
                             T.StructField("reason", _TEXT), T.StructField("late", T.LongType())])
ALARM_OUT = T.StructType([T.StructField("sleeve", _TEXT), T.StructField("date", _TEXT), T.StructField("rise", _NUM),
                          T.StructField("fall", _NUM), T.StructField("alarm", T.BooleanType())])


def _stateful(rows: DataFrame, processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    return rows.select("sleeve", "date", "day_return").groupBy("sleeve").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None")


def stream_governor(rows: DataFrame) -> DataFrame:
    return _stateful(rows, GovernorProcessor(), GOVERNOR_OUT)


def stream_page_hinkley(rows: DataFrame) -> DataFrame:
    return _stateful(rows, PageHinkleyProcessor(), ALARM_OUT)


def stream_standings(rows: DataFrame) -> DataFrame:
    """Running scoreboard (update mode): one state row per sleeve."""
    r = c("day_return")
    sd = F.stddev_samp(r)
    return rows.groupBy("sleeve").agg(
        F.count(r).alias("n_days"), (F.product(1 + r) - 1).alias("cum_return"),
        F.when(sd > 0, F.avg(r) / sd * (252 ** 0.5)).alias("sharpe"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.max("date").alias("last_date"),
        F.max_by("n_positions", "date").cast("long").alias("last_positions"))


def latest_by_batch(spark: SparkSession, out: str, key: str = "sleeve") -> DataFrame:
    """Current rows of an update-mode sink: the newest batch that mentions a key wins."""
    df = spark.read.parquet(out)
    cols = [x for x in df.columns if x not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(key, "_r.*")


def stream_period_rollup(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Compounded return per Monday-to-Sunday week and sleeve, emitted once the week is complete."""
    week = F.window("ts", "7 days", startTime="4 days")  # the epoch was a Thursday
    return rows.withWatermark("ts", delay).where("day_return IS NOT NULL").groupBy(week, "sleeve").agg(
        (F.product(1 + c("day_return")) - 1).alias("ret")).select(
        c("window.start").cast("date").alias("period"), "sleeve", "ret")
