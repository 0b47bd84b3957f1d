"""Block bootstrap of return series."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def block_start(sim, block, seed: int, n, width: int):
    """Start of a drawn block in [0, n - width): integer arithmetic, so any engine draws the same."""
    h = F.pmod((c(sim) * 1103515 + c(block) * 12345 + F.lit(seed * 7919)) * 69069 + 362437, F.lit(2147483647))
    h = F.pmod(h * 48271, F.lit(2147483647))
    return F.pmod(h, n - width)


def bootstrap_sims(returns: DataFrame, n_sims: int = 1000, block: int = 10, seed: int = 0) -> DataFrame:
    """Sharpe and total return of every simulated path: ``(strategy, sim, sharpe, total)``.

    A path is a concatenation of drawn blocks cut to the original length. Per series, sums over each
    possible block (n of them) are taken once by windows; a path then adds up n / block precomputed
    blocks instead of n days, and the work spreads over series x simulations. Series shorter than two
    blocks give no paths.
    """
    w = Window.partitionBy("strategy").orderBy("date")
    rows = returns.where("ret IS NOT NULL").select(
        "strategy", "ret", (F.row_number().over(w) - 1).cast("long").alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy("strategy")).alias("_n")).where(c("_n") >= 2 * block)
    size = rows.groupBy("strategy").agg(F.max("_n").alias("_n"), (F.ceil(F.max("_n") / block)).cast("long").alias("_b"))
    rest = c("_n") - (c("_b") - 1) * block  # length of the last, cut block
    ahead = Window.partitionBy("strategy").orderBy("_i").rowsBetween(0, block - 1)

    def block_sums(upto):
        x = F.filter("_w", lambda e, i: i < upto)
        fold = lambda f: F.aggregate(x, F.lit(0.0), lambda a, e: a + f(e))
        return [fold(lambda e: e), fold(lambda e: e * e), F.aggregate(x, F.lit(1.0), lambda a, e: a * (1 + e))]

    wins = rows.withColumns({"_w": F.collect_list("ret").over(ahead), "_b": F.ceil(c("_n") / block).cast("long")})
    names = ["s", "q", "g"]
    table = wins.select(
        "strategy", c("_i").alias("_start"),
        *[e.alias(f"_full_{k}") for k, e in zip(names, block_sums(F.lit(block)))],
        *[e.alias(f"_last_{k}") for k, e in zip(names, block_sums(rest))])
    # every series runs every simulation; the draws are rows made from the series, nothing is crossed
    draws = size.withColumn("sim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sims - 1).cast("long"))))
    draws = draws.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), c("_b") - 1)))
    draws = draws.withColumn("_start", block_start("sim", "_k", seed, c("_n"), block))
    is_last = c("_k") == c("_b") - 1
    got = draws.join(table, ["strategy", "_start"]).select(
        "strategy", "sim", "_n", *[F.when(is_last, c(f"_last_{k}")).otherwise(c(f"_full_{k}")).alias(k) for k in names])
    per_sim = got.groupBy("strategy", "sim").agg(
        F.first("_n").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"), (F.product("g") - 1).alias("total"))
    mean = c("_s") / c("_n")
    sd = F.sqrt(F.greatest(c("_q") - c("_n") * mean * mean, F.lit(0.0)) / (c("_n") - 1))
    return per_sim.select("strategy", "sim", F.when(sd > 0, mean / sd * math.sqrt(252)).otherwise(0.0).alias("sharpe"), "total")


def block_bootstrap(returns: DataFrame, n_sims: int = 1000, block: int = 10, seed: int = 0) -> DataFrame:
    """Summary per series; a series shorter than two blocks keeps its row with nulls."""
    sims = bootstrap_sims(returns, n_sims, block, seed)
    mean, sd = F.avg("total"), F.stddev_pop("total")
    out = sims.groupBy("strategy").agg(
        F.avg("sharpe").alias("mc_sharpe_mean"), F.stddev_pop("sharpe").alias("mc_sharpe_std"), mean.alias("mc_total_mean"),
        F.percentile("total", F.lit(0.05)).alias("mc_total_p05"), F.percentile("total", F.lit(0.95)).alias("mc_total_p95"),
        F.when(sd > 0, mean / sd).alias("mc_stability"))
    return returns.select("strategy").distinct().join(out, "strategy", "left")
