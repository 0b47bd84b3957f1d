"""Landed filing and macro files: company facts, ticker map, insider form tables and documents."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import to_number

c = F.col

_FACT = "array<struct<`end`:date,val:double,fp:string,filed:date>>"
_CONCEPTS = f"map<string,struct<units:map<string,{_FACT}>>>"
FACTS_SCHEMA = f"ticker string, facts struct<`us-gaap`:{_CONCEPTS},dei:{_CONCEPTS}>"


def explode_facts(raw: DataFrame) -> DataFrame:
    """Nested facts to ``(ticker, concept, unit, end, val, fp, filed)``: one explode per level."""
    empty = F.create_map().cast(_CONCEPTS)
    both = F.map_concat(
        F.coalesce(c("facts.us-gaap"), empty),
        F.map_filter(F.coalesce(c("facts.dei"), empty),
                     lambda k, _: ~F.map_contains_key(F.coalesce(c("facts.us-gaap"), empty), k)),
    )
    return (
        raw.select("ticker", F.explode(both).alias("concept", "_n"))
        .select("ticker", "concept", F.explode("_n.units").alias("unit", "_v"))
        .select("ticker", "concept", "unit", F.inline("_v"))
    )


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return explode_facts(spark.read.schema(FACTS_SCHEMA).json(path))


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{ticker, cik_str}`` to ``(ticker, cik)`` with upper-case tickers."""
    return spark.read.schema("ticker string, cik_str long").json(path).select(
        F.upper("ticker").alias("ticker"), c("cik_str").alias("cik"))


def annual_only(facts: DataFrame, flow_concepts: Sequence[str] | None = None) -> DataFrame:
    """Full-year values; with ``flow_concepts`` other concepts pass unchanged."""
    full_year = c("fp") == "FY"
    return facts.where(full_year if flow_concepts is None else full_year | ~c("concept").isin(*flow_concepts))


def open_market_only(tx: DataFrame, code: str = "TRANS_CODE") -> DataFrame:
    """Purchases and sales only."""
    return tx.where(c(code).isin("P", "S"))


SUBMISSION = ["ACCESSION_NUMBER", "FILING_DATE", "ISSUERTRADINGSYMBOL"]
NONDERIV = ["ACCESSION_NUMBER", "TRANS_CODE", "TRANS_SHARES", "TRANS_PRICEPERSHARE"]


def read_form345(spark: SparkSession, folder: str, name: str, columns: Sequence[str]) -> DataFrame:
    """One tab-separated table over all quarter folders (``quarter=2021q1/...``), all strings.

    The quarter is a partition column, so a job over few quarters reads only those.
    """
    raw = (
        spark.read.option("sep", "\t").option("header", True).option("basePath", folder)
        .csv(f"{folder}/quarter=*/{name}")
    )
    up = raw.toDF(*[x if x == "quarter" else x.upper() for x in raw.columns])
    return up.select(*[c(x) if x in up.columns else F.lit(None).cast("string").alias(x) for x in columns], "quarter")


def resume_quarters(todo: DataFrame, done: DataFrame) -> DataFrame:
    return todo.join(done.select("quarter"), "quarter", "left_anti")


_VALUE = T.StructType([T.StructField("value", T.StringType())])
FORM4_SCHEMA = T.StructType([
    T.StructField("transactionCoding", T.StructType([T.StructField("transactionCode", T.StringType())])),
    T.StructField("transactionAmounts", T.StructType([
        T.StructField("transactionShares", _VALUE), T.StructField("transactionPricePerShare", _VALUE)])),
])


def read_form4_xml(spark: SparkSession, path: str) -> DataFrame:
    """Open-market transactions of ownership documents with their signed value.

    One task reads a document from end to end and takes several small ones: a table has to be landed in
    documents of bounded size, not in one that grows with it.
    """
    raw = spark.read.format("xml").option("rowTag", "nonDerivativeTransaction").schema(FORM4_SCHEMA).load(path)
    flat = raw.select(
        c("transactionCoding.transactionCode").alias("code"),
        F.coalesce(to_number(c("transactionAmounts.transactionShares.value")), F.lit(0.0)).alias("shares"),
        F.coalesce(to_number(c("transactionAmounts.transactionPricePerShare.value")), F.lit(0.0)).alias("price"),
    )
    buy, value = c("code") == "P", c("shares") * c("price")
    return open_market_only(flat, "code").withColumns(
        {"signed_value": F.when(buy, value).otherwise(-value), "is_purchase": buy.cast("int")})


def pivot_macro(long: DataFrame, series: Sequence[str]) -> DataFrame:
    """``(date, series, value text)`` to one column per series; days without any number are dropped."""
    num = long.withColumn("value", to_number("value"))
    return num.groupBy("date").pivot("series", list(series)).agg(F.max("value")).dropna(how="all", subset=list(series))


def read_macro(spark: SparkSession, folder: str, series: Sequence[str]) -> DataFrame:
    """Folder with one ``series=<id>`` sub-folder of ``date,value`` CSV files per series."""
    raw = spark.read.option("header", True).schema("date date, value string").csv(folder)
    return pivot_macro(raw, series)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """``ticker,start,end`` with ``#`` comments; blank end = still a member."""
    return (
        spark.read.option("comment", "#").option("header", True)
        .schema("ticker string, start date, end date").csv(path)
    )


def resolve_universe(membership: DataFrame | None = None, static: DataFrame | None = None) -> DataFrame:
    """Distinct tickers with a flag telling whether survivorship is controlled."""
    source, safe = (membership, True) if membership is not None else (static, False)
    return source.select("ticker").distinct().withColumn("survivorship_safe", F.lit(safe))
