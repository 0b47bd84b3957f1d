"""Data sources with their share of the intended budget and their status."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed value: only live sources may be read; shadow sources are logged, not used
USABLE = {"live"}

#: fixed values: source, category, weight, status
SOURCES = [
    ("price_volume", "market_data", 0.35, "live"),
    ("sec_edgar_fundamentals", "filings", 0.10, "shadow_only"),
    ("sec_form4_insider", "filings", 0.05, "shadow_only"),
    ("sec_13f", "filings", 0.03, "not_implemented"),
    ("congress_trades", "filings", 0.02, "not_implemented"),
    ("reddit_hn_forums", "reddit", 0.10, "infeasible"),
    ("github_dev_activity", "github", 0.10, "not_implemented"),
    ("macro_fred", "macro", 0.06, "shadow_only"),
    ("cftc_cot", "macro", 0.02, "not_implemented"),
    ("treasury_bls", "macro", 0.02, "not_implemented"),
    ("news_apis", "news", 0.05, "infeasible"),
    ("crypto_onchain_tvl", "crypto_native", 0.05, "not_implemented"),
    ("discord_telegram", "messaging", 0.05, "infeasible"),
]


def source_registry(spark) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, category string, weight double, status string")


def source_coverage(registry: DataFrame) -> DataFrame:
    """Live weight and intended weight per category."""
    live = F.sum(F.when(F.col("status") == "live", F.col("weight")).otherwise(0.0))
    return registry.groupBy("category").agg(live.alias("live_weight"), F.sum("weight").alias("weight"))


def live_fraction(registry: DataFrame) -> DataFrame:
    cov = source_coverage(registry)
    return cov.agg(F.round(F.sum("live_weight"), 4).alias("live_fraction"))


def require_source(name: str) -> str:
    """Status of a usable source; anything else raises, nothing is ever made up in its place."""
    status = {s: st for s, _, _, st in SOURCES}.get(name, "unknown")
    if status not in USABLE:
        raise NotImplementedError(f"data source {name!r} is not available (status={status})")
    return status
