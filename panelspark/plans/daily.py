"""The daily run as one job: attribute, govern, decide, combine, log, summarise."""
from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitor as mon
from ..operators import portfolio as pf
from ..operators.governance import governor_today
from ..operators.joins import latest_per_key
from ..session import stored
from ..sources.ledger import DECISION, append_if_newer, with_positions
from .books import BOOKS, Book, build_books, combine_system, decide_books

c = F.col

#: fixed values: shares of the combined system, and the names of its row and of the passive market row
SYSTEM_CAPS = {"stocks": 0.65, "metals": 0.15, "crypto": 0.20}
SYSTEM, MARKET = "full_system", "market"


def daily_run(ledger: DataFrame, bars: DataFrame, bench: DataFrame, assignment: DataFrame, books: Sequence[Book] = BOOKS,
              scores: DataFrame | None = None, caps: Mapping[str, float] = SYSTEM_CAPS, **inputs) -> tuple[DataFrame, DataFrame]:
    """``(rows, summary)``: the ledger rows of the run and one line per sleeve.

    From the ledger come the last targets of every sleeve (what is held now, and what the realised return since
    then is measured on), the governor's exposure, and the learning multipliers. Books are built for the last
    date (or decided from given ``scores(book, date, ticker, score)``), the system combines them, and the passive
    market row is the yardstick nobody governs. ``rows`` holds only what is newer than the sleeve's last row, so a
    second run of a day adds nothing; append it with ``append_ledger``. ``summary(sleeve, date, n_positions,
    exposure, day_return, logged, n_days, cum_return, sharpe, governor)``: returns of skipped rows are null.
    ``inputs`` go to :func:`build_books` (sectors, filings, insider, microcaps).
    """
    spark = bars.sparkSession
    ledger = ledger.select("date", "sleeve", "day_return", c("decisions").cast(f"array<{DECISION}>").alias("decisions"))
    before = latest_per_key(ledger)
    held = before.select("sleeve", c("date").alias("d0"), F.inline("decisions")).select("sleeve", "d0", c("asset").alias("ticker"), c("target_weight").alias("weight"))
    gates = governor_today(ledger.select(c("sleeve").alias("strategy"), "date", c("day_return").alias("ret")))
    current = held.select(c("sleeve").alias("book"), "ticker", "weight")
    governor = gates.select(c("strategy").alias("book"), "exposure")
    if scores is not None:
        decided = decide_books(scores, bars, bench, assignment, books, current=current, governor=governor, microcaps=inputs.get("microcaps"))
    else:
        decided = build_books(bars, bench, assignment, books, current=current, governor=governor, **inputs)
    decided = stored(spark, decided, "decided")

    # a sleeve is a book, the system or the market; all have rows (sleeve, date, ticker, decision fields, weight)
    fields = ["action", "ev_score", "risk_status", "confidence", "reasoning"]
    own = decided.where("ticker IS NOT NULL").select(c("book").alias("sleeve"), "date", "ticker", *fields, "weight")
    system_gate = gates.where(c("strategy") == SYSTEM).agg(F.coalesce(F.max("exposure"), F.lit(1.0))).scalar()
    multipliers = pf.learning_multipliers(mon.rolling_performance(ledger))
    combined = combine_system(decided.where("weight > 0"), dict(caps), multipliers).withColumn("weight", c("weight") * system_gate)
    system = combined.select(F.lit(SYSTEM).alias("sleeve"), "date", "ticker", F.lit("BUY").alias("action"), *[F.lit(None).cast("double" if x in ("ev_score", "confidence") else "string").alias(x)
                                                                                                                   for x in fields[1:]], "weight")
    last = decided.agg(F.max("date")).scalar()
    market = spark.range(1).select(F.lit(MARKET).alias("sleeve"), last.alias("date"), F.lit(MARKET).alias("ticker"), F.lit("BUY").alias("action"), F.lit(0.0).alias("ev_score"),
                                   F.lit("LOW").alias("risk_status"), F.lit(100.0).alias("confidence"), F.lit("buy_and_hold").alias("reasoning"), F.lit(1.0).alias("weight"))
    every = own.unionByName(system).unionByName(market)

    # realised return: the last targets over the gap, at prices known on both days
    now = every.groupBy("sleeve").agg(F.max("date").alias("d1"))
    prices = bars.select("date", "ticker", "close").unionByName(bench.select("date", F.lit(MARKET).alias("ticker"), "close"))
    gained = mon.realized_gap_return(held.join(now, "sleeve").select("sleeve", "ticker", "weight", "d0", "d1"), prices)

    entry = F.struct(c("ticker").alias("asset"), *[c(x) for x in fields[:4]], c("weight").alias("target_weight"), "reasoning", F.lit("daily_run").alias("sources"))
    rows = every.groupBy("sleeve", "date").agg(F.array_sort(F.collect_list(entry)).cast(f"array<{DECISION}>").alias("decisions"))
    rows = with_positions(rows.join(gained, "sleeve", "left").select("date", "sleeve", F.lit("shadow").alias("status"), "day_return", "decisions"))
    fresh = stored(spark, append_if_newer(rows, ledger), "fresh")
    seen = ledger.select("date", "sleeve", "day_return").unionByName(fresh.select("date", "sleeve", "day_return"))
    performance = mon.rolling_performance(seen).select("sleeve", "n_days", "cum_return", "sharpe")
    summary = (
        rows.select("sleeve", "date", "n_positions", F.aggregate("decisions", F.lit(0.0), lambda a, d: a + d["target_weight"]).alias("exposure"))
        .join(fresh.select("sleeve", "date", "day_return", F.lit(True).alias("_new")), ["sleeve", "date"], "left")
        .join(performance, "sleeve", "left").join(gates.select(c("strategy").alias("sleeve"), "reason"), "sleeve", "left")
        .select("sleeve", "date", "n_positions", "exposure", "day_return", F.coalesce("_new", F.lit(False)).alias("logged"), F.coalesce("n_days", F.lit(0)).alias("n_days"),
                "cum_return", "sharpe", F.coalesce("reason", F.lit("ok")).alias("governor")))
    return fresh, summary
