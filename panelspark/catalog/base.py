"""Registry of named queries, each with the SQL that must give the same rows.

The SQL side builds the same inputs by its own means (grids, as-of joins, plain prefix sums), so that
it checks the Spark side instead of repeating it.
"""
from __future__ import annotations

import re
from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: Dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: Dict[str, str] = {}

CTE: Dict[str, str] = {
    "bars": """
        SELECT cast(l_shipdate AS DATE) AS date, p_brand AS ticker,
               arg_min(l_extendedprice, k) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
               arg_max(l_extendedprice, k) AS close, sum(l_quantity) AS volume
        FROM (SELECT *, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey AS k FROM lineitem)
        JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "cal": """
        SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos
        FROM (SELECT DISTINCT cast(l_shipdate AS DATE) AS date FROM lineitem)""",
    "names": "SELECT DISTINCT p_brand AS ticker, cast(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS num FROM part",
    "filled": """
        SELECT g.date, g.pos, g.ticker, b.open, b.high, b.low, b.close, b.volume
        FROM (SELECT date, pos, ticker FROM cal, names) g
        ASOF JOIN bars b ON g.ticker = b.ticker AND g.date >= b.date""",
    "bench": "SELECT date, pos, avg(close) AS close FROM filled GROUP BY 1, 2",
    "refbars": """
        SELECT cast(l_shipdate AS DATE) AS date, p_type AS ref,
               arg_max(l_extendedprice, l_orderkey * 1000000000 + l_linenumber * 10000000 + l_partkey) AS close
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "refs": """
        SELECT g.date, g.pos, g.ref, b.close
        FROM (SELECT date, pos, ref FROM cal, (SELECT DISTINCT p_type AS ref FROM part)) g
        ASOF JOIN refbars b ON g.ref = b.ref AND g.date >= b.date""",
    "sectors": "SELECT ticker, r_name AS sector FROM names LEFT JOIN region ON num % 5 = r_regionkey",
    "membership": """
        SELECT ticker, DATE '1995-01-01' AS start, CASE WHEN num % 2 = 0 THEN DATE '1999-12-31' END AS "end" FROM names
        UNION ALL SELECT ticker, DATE '2000-07-01', NULL FROM names WHERE num % 4 = 0""",
    "filing_wide": """
        SELECT p_brand AS ticker, max(cast(o_orderdate AS DATE)) AS filed,
               cast(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS num,
               sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS shares,
               sum(o_totalprice) AS equity, sum(l_extendedprice * l_discount) AS net_income,
               sum(CASE WHEN l_tax > 0.03 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS gross_profit,
               sum(l_extendedprice * l_tax) AS operating_income,
               sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END) AS liabilities
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY p_brand, date_trunc('quarter', o_orderdate)""",
    "filings": """
        SELECT ticker, filed, unnest(['revenue','shares','equity','net_income','gross_profit','operating_income','liabilities','debt']) AS concept,
               unnest([revenue, shares, equity, net_income, gross_profit, operating_income, liabilities,
                       CASE WHEN num % 3 = 0 THEN liabilities / 2 END]) AS value
        FROM filing_wide""",
    "insider": """
        SELECT p_brand AS ticker, cast(l_shipdate AS DATE) AS filed,
               CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * (l_quantity * l_extendedprice * l_discount) AS signed_value,
               CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_purchase
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N'""",
    "macro": """
        SELECT date, t AS T10Y2Y, CASE WHEN isodow(date) = 5 THEN n END AS NFCI FROM (
            SELECT cast(o_orderdate AS DATE) AS date, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE -1 END) AS t,
                   avg(o_totalprice) / 250000 - 1 AS n FROM orders GROUP BY 1)""",
    "decisions": """
        SELECT date, sleeve, asset, n / sum(n) OVER (PARTITION BY date, sleeve) / 2 AS target_weight FROM (
            SELECT cast(ts AS DATE) AS date, 'sleeve_' || (user_id % 9) AS sleeve, event_type AS asset, count(*)::DOUBLE AS n
            FROM events GROUP BY 1, 2, 3)""",
    "ledger": """
        SELECT cast(ts AS DATE) AS date, 'sleeve_' || (user_id % 9) AS sleeve, 'shadow' AS status,
               count(DISTINCT event_type) AS n_positions, (avg(value) - 50) / 1000 AS day_return
        FROM events GROUP BY 1, 2""",
    "rets": """
        SELECT ticker AS strategy, date, r AS ret FROM (
            SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM filled)
        WHERE r IS NOT NULL""",
    "scored": """
        SELECT date, pos, ticker, close, volume, ln(close) - ln(lag(close, 20) OVER (PARTITION BY ticker ORDER BY date)) AS score
        FROM filled""",
}


def cte(name: str, sql: str) -> None:
    assert name not in CTE or CTE[name] == sql, name
    CTE[name] = sql


def with_inputs(body: str) -> str:
    """Prefix the named inputs a query mentions, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", sql)):
            if word in CTE and word not in order:
                visit_one(word)

    def visit_one(name: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", CTE[name])):
            if word in CTE and word != name and word not in order and re.search(rf"(FROM|JOIN|,|\(SELECT \w+ FROM)\s+{word}\b", CTE[name]):
                visit_one(word)
        order.append(name)

    for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)", body)):
        if word in CTE and word not in order:
            visit_one(word)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    if re.match(r"\s*WITH\s+RECURSIVE", body):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"^\s*WITH\s+RECURSIVE", "", body, count=1)
    if re.match(r"\s*WITH\b", body):
        return f"WITH {head},\n" + re.sub(r"^\s*WITH\b", "", body, count=1)
    return f"WITH {head}\n{body}"


def r(x: str, digits: int = 6) -> str:
    """Rounded value without a negative zero, SQL side."""
    return f"(round({x}, {digits}) + 0.0::DOUBLE)"


def rc(x, digits: int = 6):
    """Rounded value, Spark side."""
    col = F.col(x) if isinstance(x, str) else x
    return F.round(col.cast("double"), digits)


def _text_dates(df: DataFrame) -> DataFrame:
    """Dates leave as ISO text, so both sides compare the same way in any client."""
    days = {f.name for f in df.schema if isinstance(f.dataType, T.DateType)}
    return df.select(*[F.col(c).cast("string").alias(c) if c in days else F.col(c) for c in df.columns])


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None, dates: str = "date") -> None:
    """Register a query; ``dates`` names the date columns of the SQL result (space separated)."""
    assert name not in QUERIES, name
    QUERIES[name] = lambda spark, folder: _text_dates(fn(spark, folder))
    if sql is not None:
        text = ", ".join(f"cast({d} AS VARCHAR) AS {d}" for d in dates.split())
        body = with_inputs(sql)
        ORACLES[name] = f"SELECT * REPLACE ({text}) FROM (\n{body}\n)" if text else body
