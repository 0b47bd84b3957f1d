"""Queries over sources, projections, joins, cross-sections and set operations."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as col
from ..functions.ranks import rank_split
from ..functions.windows import add_features, series
from ..operators import cross_section as xs
from ..operators import fundamentals as fund
from ..operators import joins, technical as tech
from ..session import shared_folder
from ..sources import bars as b
from ..sources import filings as fil
from ..sources import ledger as led
from ..sources import registry as reg
from ..sources import tables as t
from .base import add, cte, r, rc
from .features import W, roll

c = F.col


def scratch(spark, stem: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def pct_sql(x: str, by: str = "date") -> str:
    w = f"OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST)"
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() {w} + count({x}) {w}) / 2.0::DOUBLE / "
            f"count({x}) OVER (PARTITION BY {by}) END")


OHLCV = ["open", "high", "low", "close", "volume"]
_ohlcv_sql = ", ".join(f"{r(x, 2)} AS {x}" for x in OHLCV)
_ohlcv = lambda df: df.select("date", "ticker", *[rc(x, 2).alias(x) for x in OHLCV])

cte("labels", f"SELECT date, pos, ticker, fwd, fwd - avg(fwd) OVER (PARTITION BY date) AS target FROM (SELECT date, pos, ticker, lead(close, 5) OVER ({W}) / close - 1 AS fwd FROM filled)")
cte("pairs", "SELECT s.date, s.pos, s.ticker, score, target FROM scored s JOIN labels l ON s.date = l.date AND s.ticker = l.ticker WHERE score IS NOT NULL AND target IS NOT NULL")

# --- sources ----------------------------------------------------------------------------------------
add("ohlcv_bars", lambda s, d: _ohlcv(t.bars(s, d)), f"SELECT date, ticker, {_ohlcv_sql} FROM bars")
add("align_bars", lambda s, d: _ohlcv(t.bars_filled(s, d)), f"SELECT date, ticker, {_ohlcv_sql} FROM filled")


def _write_read(s, d):
    path = scratch(s, "bars")
    b.write_bars(t.bars(s, d), path)
    return b.read_bars(s, path)


add("write_read_bars", lambda s, d: _ohlcv(_write_read(s, d)), f"SELECT date, ticker, {_ohlcv_sql} FROM bars")
add("read_bars_slice", lambda s, d: _ohlcv(b.read_bars(s, _written(s, d), ["Brand#3", "Brand#7", "Brand#99"])),
    f"SELECT date, ticker, {_ohlcv_sql} FROM bars WHERE ticker IN ('Brand#3', 'Brand#7')")


def _written(s, d):
    path = scratch(s, "bars")
    b.write_bars(t.bars(s, d), path)
    return path


def _wide_pair(s, d):
    wide = b.long_to_wide(t.bars(s, d).select("date", "ticker", "close"))
    return b.wide_to_long(wide).select("date", "ticker", rc("close", 2).alias("close"))


add("wide_long_roundtrip", _wide_pair, f"SELECT date, ticker, {r('close', 2)} AS close FROM bars")
add("long_to_wide",
    lambda s, d: b.long_to_wide(t.bars(s, d), "close", [f"Brand#{k}" for k in range(1, 26)]).select(
        "date", *[rc(c(f"`Brand#{k}`"), 2).alias(f"brand_{k}") for k in range(1, 26)]),
    "SELECT date, " + ", ".join(f"{r(f'max(CASE WHEN ticker = {chr(39)}Brand#{k}{chr(39)} THEN close END)', 2)} AS brand_{k}" for k in range(1, 26)) + " FROM bars GROUP BY date")


def _membership_csv(s, d):
    """Membership as files with a header, and one that holds nothing but comments."""
    path = scratch(s, "membership")
    t.membership(s, d).select(F.regexp_replace("ticker", "Brand#", "B").alias("ticker"), "start", "end").write.option("header", True).csv(path)
    s.range(1).select(F.lit("# members since the start, blank: still a member")).write.mode("append").text(path)
    return fil.read_membership(s, path)


add("read_membership",
    lambda s, d: _membership_csv(s, d).select("ticker", c("start").alias("start_date"), c("end").alias("end_date")),
    """SELECT replace(ticker, 'Brand#', 'B') AS ticker, start AS start_date, "end" AS end_date FROM membership""",
    dates="start_date end_date")
add("resolve_universe", lambda s, d: fil.resolve_universe(membership=t.membership(s, d)),
    "SELECT DISTINCT ticker, true AS survivorship_safe FROM membership", dates="")


def _facts_json(s, d):
    """Filings per brand nested the way company facts are published."""
    path = scratch(s, "facts")
    f = t.filings(s, d).select(
        "ticker", "concept",
        F.struct(c("filed").alias("end"), c("value").alias("val"), F.lit("FY").alias("fp"), "filed").alias("x"))
    by_concept = f.groupBy("ticker", "concept").agg(F.collect_list("x").alias("xs")).select(
        "ticker", F.struct("concept", F.struct(F.create_map(F.lit("USD"), c("xs")).alias("units"))).alias("e"))
    by_concept.groupBy("ticker").agg(F.map_from_entries(F.collect_list("e")).alias("g")).select(
        "ticker", F.struct(c("g").alias("us-gaap")).alias("facts")).write.json(path)
    return fil.read_company_facts(s, path)


add("read_company_facts",
    lambda s, d: _facts_json(s, d).select("ticker", "concept", "unit", c("end").alias("period_end"), rc("val", 4).alias("val"), "fp", "filed"),
    f"SELECT ticker, concept, 'USD' AS unit, filed AS period_end, {r('value', 4)} AS val, 'FY' AS fp, filed FROM filings WHERE value IS NOT NULL",
    dates="period_end filed")


def _ticker_map(s, d):
    path = scratch(s, "map")
    t.table(s, d, "part").select(F.lower("p_brand").alias("ticker"), (t.brand_number("p_brand").cast("long") + 1000).alias("cik_str")).distinct().write.json(path)
    return fil.read_ticker_map(s, path)


add("read_ticker_map", _ticker_map, "SELECT upper(ticker) AS ticker, (num + 1000)::BIGINT AS cik FROM names", dates="")


def _form_tables(s, d):
    """Line items and orders as the two quarterly tables of the insider data set."""
    orders = t.table(s, d, "orders").select(
        c("o_orderkey").cast("string").alias("accession_number"),
        F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("filing_date"),
        F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")).alias("issuertradingsymbol"),
        F.lower(F.concat(F.year("o_orderdate"), F.lit("q"), F.quarter("o_orderdate"))).alias("quarter"))
    lines = t.table(s, d, "lineitem").join(
        t.table(s, d, "orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).select(
        c("l_orderkey").cast("string").alias("accession_number"),
        F.when(c("l_returnflag") == "A", "P").when(c("l_returnflag") == "R", "S").otherwise("A").alias("trans_code"),
        F.when(c("l_linenumber") == 7, "").otherwise(c("l_quantity").cast("string")).alias("trans_shares"),
        F.when(c("l_linenumber") == 6, "n/a").otherwise(c("l_extendedprice").cast("string")).alias("trans_pricepershare"),
        F.lower(F.concat(F.year("o_orderdate"), F.lit("q"), F.quarter("o_orderdate"))).alias("quarter"))
    folder = scratch(s, "form345")
    for name, df in (("submission", orders), ("nonderiv_trans", lines)):
        df.withColumn("table", F.lit(name)).write.mode("append").partitionBy("quarter", "table").option("sep", "\t").option("header", True).csv(folder)
    return folder


add("read_form345",
    lambda s, d: (lambda f: fil.read_form345(s, f, "table=submission", fil.SUBMISSION).groupBy("quarter").agg(
        F.countDistinct("ACCESSION_NUMBER").alias("n"), F.max(col.parse_filing_date("FILING_DATE")).alias("last_filed")))(_form_tables(s, d)),
    """SELECT year(o_orderdate) || 'q' || quarter(o_orderdate) AS quarter, count(*)::BIGINT AS n, max(cast(o_orderdate AS DATE)) AS last_filed
       FROM orders GROUP BY 1""", dates="last_filed")


def _submission_join(s, d):
    f = _form_tables(s, d)
    universe = t.table(s, d, "orders").select(F.upper("o_orderpriority").alias("ticker")).where("ticker < '4'").distinct()
    tx = joins.submission_join(
        fil.read_form345(s, f, "table=submission", fil.SUBMISSION), fil.read_form345(s, f, "table=nonderiv_trans", fil.NONDERIV).drop("quarter"), universe)
    return fund.daily_insider_flow(tx).select("ticker", "date", rc("signed_value", 2).alias("signed_value"), c("purchases").cast("long").alias("purchases"))


add("submission_join", _submission_join,
    f"""SELECT upper(o_orderpriority) AS ticker, cast(o_orderdate AS DATE) AS date,
        {r('''sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END
            * CASE WHEN l_linenumber = 6 THEN 0 ELSE l_extendedprice END)''', 2)} AS signed_value,
        sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS purchases
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag <> 'N' AND upper(o_orderpriority) < '4' GROUP BY 1, 2""")


PLAIN_ROWS = 1_000_000  # transactions up to which ownership documents stay plain text (0.45 GB)


def _form4(s, d):
    """Documents of 100,000 transactions, 45 MB of text each, as a document is not split; a large table's are gzipped."""
    path = scratch(s, "form4")
    value = lambda x: F.struct(x.cast("string").alias("value"))
    lines = t.table(s, d, "lineitem")
    lines.select(
        F.struct(F.when(c("l_returnflag") == "A", "P").when(c("l_returnflag") == "R", "S").otherwise("A").alias("transactionCode")).alias("transactionCoding"),
        F.struct(value(c("l_quantity")).alias("transactionShares"), value(c("l_extendedprice")).alias("transactionPricePerShare")).alias("transactionAmounts"),
    ).write.format("xml").option("rootTag", "nonDerivativeTable").option("rowTag", "nonDerivativeTransaction").option(
        "maxRecordsPerFile", 100_000).option("compression", "gzip" if lines.count() > PLAIN_ROWS else "none").save(path)
    return fil.read_form4_xml(s, path)


add("read_form4_xml",
    lambda s, d: _form4(s, d).groupBy("code", "is_purchase").agg(
        F.count(F.lit(1)).alias("n"), rc(F.sum("shares"), 2).alias("shares"), rc(F.sum("signed_value"), 2).alias("signed_value")),
    f"""SELECT CASE WHEN l_returnflag = 'A' THEN 'P' ELSE 'S' END AS code, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_purchase,
        count(*) AS n, {r('sum(l_quantity)', 2)} AS shares,
        {r("sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END * l_quantity * l_extendedprice)", 2)} AS signed_value
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2""", dates="")


def _macro_files(s, d):
    path = scratch(s, "macro")
    m = t.macro(s, d)
    long = m.unpivot(["date"], ["T10Y2Y", "NFCI"], "series", "value").where("value IS NOT NULL").withColumn(
        "value", F.when(F.dayofmonth("date") == 13, ".").otherwise(c("value").cast("string")))
    long.write.partitionBy("series").option("header", True).csv(path)
    return fil.read_macro(s, path, ["T10Y2Y", "NFCI"])


add("read_macro",
    lambda s, d: _macro_files(s, d).select("date", rc("T10Y2Y").alias("t10y2y"), rc("NFCI").alias("nfci")),
    f"""SELECT date, {r('T10Y2Y')} AS t10y2y, {r('NFCI')} AS nfci FROM macro
        WHERE day(date) <> 13 AND (T10Y2Y IS NOT NULL OR NFCI IS NOT NULL)""")


def _ledger_files(s, d):
    path = scratch(s, "ledger")
    t.ledger(s, d).write.json(path)
    return led.read_ledger(s, path)


add("read_ledger",
    lambda s, d: _ledger_files(s, d).select("date", "sleeve", "status", c("n_positions").cast("long").alias("n_positions"), rc("day_return", 14).alias("day_return")),
    f"SELECT date, sleeve, status, n_positions::BIGINT AS n_positions, {r('day_return', 14)} AS day_return FROM ledger")


def _append(s, d):
    path = scratch(s, "append")
    rows = t.ledger(s, d)
    led.append_ledger(rows.where("date < '2024-01-20'"), path)
    led.append_ledger(led.append_if_newer(rows, s.read.parquet(path)), path)
    led.append_ledger(led.append_if_newer(rows, s.read.parquet(path)), path)  # a re-run adds nothing
    return s.read.parquet(path)


add("append_ledger",
    lambda s, d: _append(s, d).select("date", "sleeve", c("n_positions").cast("long").alias("n_positions"), rc("day_return", 14).alias("day_return")),
    f"SELECT date, sleeve, n_positions::BIGINT AS n_positions, {r('day_return', 14)} AS day_return FROM ledger")
add("append_if_newer",
    lambda s, d: led.append_if_newer(t.ledger(s, d), t.ledger(s, d).where("date < '2024-01-20'")).select("date", "sleeve", rc("day_return", 14).alias("day_return")),
    f"SELECT date, sleeve, {r('day_return', 14)} AS day_return FROM ledger WHERE date >= DATE '2024-01-20'")
add("except_logged",
    lambda s, d: t.ledger(s, d).select("sleeve", "date").join(
        t.ledger(s, d).where("day_return < 0").select("sleeve", "date"), ["sleeve", "date"], "left_anti"),
    "SELECT sleeve, date FROM ledger EXCEPT SELECT sleeve, date FROM ledger WHERE day_return < 0")


def _refresh(s, d):
    path = scratch(s, "snapshot")
    m = t.macro(s, d).select("date", "T10Y2Y")
    led.refresh_if_nonempty(m, path)
    led.refresh_if_nonempty(m.where("date < '1900-01-01'"), path)  # empty: the snapshot stays
    return led.read_snapshot(s, path)


add("refresh_if_nonempty", lambda s, d: _refresh(s, d).select("date", rc("T10Y2Y").alias("t10y2y")),
    f"SELECT date, {r('T10Y2Y')} AS t10y2y FROM macro")
_quarter = lambda: F.lower(F.concat(F.year("o_orderdate"), F.lit("q"), F.quarter("o_orderdate"))).alias("quarter")
add("resume_quarters",
    lambda s, d: fil.resume_quarters(
        t.table(s, d, "orders").select(_quarter()).distinct(),
        t.table(s, d, "orders").where("o_orderdate < '1999-01-01'").select(_quarter()).distinct()),
    """SELECT DISTINCT year(o_orderdate) || 'q' || quarter(o_orderdate) AS quarter FROM orders WHERE o_orderdate >= '1999-01-01'""", dates="")


def _registry(s, d):
    docs = t.table(s, d, "documents")
    return docs.groupBy(c("source"), c("lang").alias("category")).agg(F.sum("n_chars").cast("double").alias("weight")).withColumn(
        "status", F.when(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3 == 0, "live").otherwise("shadow_only"))


add("source_coverage",
    lambda s, d: reg.source_coverage(_registry(s, d)).select("category", rc("live_weight", 2).alias("live_weight"), rc("weight", 2).alias("weight")),
    f"""SELECT lang AS category, {r("sum(CASE WHEN cast(regexp_extract(source, '[0-9]+') AS INT) % 3 = 0 THEN n_chars ELSE 0 END)::DOUBLE", 2)} AS live_weight,
        {r('sum(n_chars)::DOUBLE', 2)} AS weight FROM documents GROUP BY 1""", dates="")

# --- projections and predicates ----------------------------------------------------------------------
add("slice_universe",
    lambda s, d: b.slice_universe(t.bars(s, d), t.tickers(s, d).where(t.brand_number() % 2 == 1)).select("date", "ticker", rc("close", 2).alias("close")),
    f"SELECT date, ticker, {r('close', 2)} AS close FROM bars WHERE ticker IN (SELECT ticker FROM names WHERE num % 2 = 1)")


def _dirty(s, d):
    x = t.bars(s, d)
    return x.select("date", "ticker", "close",
                    F.when(c("high") == c("low"), F.lit(float("inf"))).when(c("volume") < 5, F.lit(float("nan"))).otherwise(c("close") / c("high")).alias("f1"),
                    F.when(c("volume") > 90, F.lit(float("-inf"))).otherwise(c("low") / c("high")).alias("target"))


_CLEAN = """SELECT date, ticker, CASE WHEN high = low OR volume < 5 THEN NULL ELSE close / high END AS f1,
    CASE WHEN volume > 90 THEN NULL ELSE low / high END AS target FROM bars"""
cte("cleaned", _CLEAN)
add("clean_nonfinite", lambda s, d: col.clean_nonfinite(_dirty(s, d)).select("date", "ticker", rc("f1").alias("f1"), rc("target").alias("target")),
    f"SELECT date, ticker, {r('f1')} AS f1, {r('target')} AS target FROM cleaned")
add("drop_incomplete", lambda s, d: col.drop_incomplete(col.clean_nonfinite(_dirty(s, d)), ["f1"]).select("date", "ticker", rc("f1").alias("f1"), rc("target").alias("target")),
    f"SELECT date, ticker, {r('f1')} AS f1, {r('target')} AS target FROM cleaned WHERE f1 IS NOT NULL AND target IS NOT NULL")
add("keep_unlabeled", lambda s, d: col.drop_incomplete(col.clean_nonfinite(_dirty(s, d)), ["f1"], True).select("date", "ticker", rc("f1").alias("f1"), rc("target").alias("target")),
    f"SELECT date, ticker, {r('f1')} AS f1, {r('target')} AS target FROM cleaned WHERE f1 IS NOT NULL")
add("safe_div", lambda s, d: t.bars(s, d).select("date", "ticker", rc(col.safe_div(c("close") - c("low"), c("high") - c("low"))).alias("q")),
    f"SELECT date, ticker, {r('(close - low) / nullif(high - low, 0)')} AS q FROM bars")
add("open_market_only",
    lambda s, d: fil.open_market_only(t.table(s, d, "lineitem").select(
        "l_returnflag", "l_quantity", F.when(c("l_returnflag") == "A", "P").when(c("l_returnflag") == "R", "S").otherwise("X").alias("TRANS_CODE"))).groupBy("TRANS_CODE").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("shares")).withColumnRenamed("TRANS_CODE", "code"),
    "SELECT CASE WHEN l_returnflag = 'A' THEN 'P' ELSE 'S' END AS code, count(*) AS n, sum(l_quantity) AS shares FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1", dates="")


def _facts_flat(s, d):
    """All filings as flat facts: two units, two competing concepts for the revenue, quarterly and annual."""
    f = t.filings(s, d)
    unit = F.when(F.month("filed") == 1, "EUR").otherwise("USD")
    concept = F.when((c("concept") == "revenue") & (t.brand_number() % 2 == 0), "sales").otherwise(c("concept"))
    fp = F.when(F.month("filed") > 9, "FY").otherwise("Q")
    base = f.select("ticker", concept.alias("concept"), unit.alias("unit"), c("filed").alias("end"), c("value").alias("val"), fp.alias("fp"), "filed")
    restated = base.where("fp = 'FY'").select("ticker", "concept", "unit", F.date_sub("end", 90).alias("end"), (c("val") * 2).alias("val"), "fp", "filed")
    return base.unionByName(restated)


cte("facts", """SELECT ticker, CASE WHEN concept = 'revenue' AND cast(regexp_extract(ticker, '[0-9]+') AS INT) % 2 = 0 THEN 'sales' ELSE concept END AS concept,
    CASE WHEN month(filed) = 1 THEN 'EUR' ELSE 'USD' END AS unit, filed AS pend, value AS val, CASE WHEN month(filed) > 9 THEN 'FY' ELSE 'Q' END AS fp, filed
    FROM filings WHERE value IS NOT NULL""")
add("annual_only", lambda s, d: fil.annual_only(t.filings(s, d).select("ticker", "concept", "filed", F.when(F.month("filed") > 9, "FY").otherwise("Q").alias("fp"), rc("value", 4).alias("value")), ["revenue", "net_income"]),
    f"""SELECT ticker, concept, filed, CASE WHEN month(filed) > 9 THEN 'FY' ELSE 'Q' END AS fp, {r('value', 4)} AS value FROM filings
        WHERE value IS NOT NULL AND (concept NOT IN ('revenue', 'net_income') OR month(filed) > 9)""", dates="filed")
add("pit_dedupe",
    lambda s, d: fund.pit_dedupe(_facts_flat(s, d), [*[(x, x) for x in fund.CONCEPTS], ("revenue", "sales")]).select(
        "ticker", "quantity", "filed", rc("value", 4).alias("value")),
    f"""SELECT ticker, CASE WHEN concept = 'sales' THEN 'revenue' ELSE concept END AS quantity, filed, {r('arg_max(val, pend)', 4)} AS value
        FROM facts WHERE unit = 'USD' GROUP BY 1, 2, 3""", dates="filed")
add("clip", lambda s, d: t.returns(s, d).select("strategy", "date", rc(col.clip("ret", -0.2, 0.3)).alias("clipped")),
    f"SELECT strategy, date, {r('greatest(least(ret, 0.3), -0.2)')} AS clipped FROM rets")
add("bucketize",
    lambda s, d: t.bars(s, d).select("date", "ticker", col.bucketize(F.when(c("volume") > 5, c("low") / c("high")), [-0.01, 1 / 3, 2 / 3, 1.01]).alias("bin")),
    "SELECT date, ticker, CASE WHEN volume <= 5 THEN NULL WHEN low / high <= 1.0::DOUBLE / 3 THEN 0.0::DOUBLE WHEN low / high <= 2.0::DOUBLE / 3 THEN 1 ELSE 2 END AS bin FROM bars")
add("first_match",
    lambda s, d: t.bars(s, d).select("date", "ticker", col.first_match(
        [(c("close") > c("open"), "up"), (c("volume") > 60, "heavy"), (c("high") == c("low"), "flat")], "other").alias("label")),
    "SELECT date, ticker, CASE WHEN close > open THEN 'up' WHEN volume > 60 THEN 'heavy' WHEN high = low THEN 'flat' ELSE 'other' END AS label FROM bars")

# --- joins ------------------------------------------------------------------------------------------------
_CONCEPTS = ["revenue", "shares", "equity", "net_income", "gross_profit", "operating_income", "liabilities", "debt"]
add("asof_join",
    lambda s, d: joins.asof_join(t.bars(s, d).select("date", "ticker", "close"), t.filings(s, d).groupBy("ticker", "filed").pivot("concept", _CONCEPTS).agg(F.max("value"))).select(
        "date", "ticker", *[rc(k, 4).alias(k) for k in _CONCEPTS]),
    f"""SELECT b.date, b.ticker, {', '.join(f"{r(f'f_{k}.value', 4)} AS {k}" for k in _CONCEPTS)} FROM bars b """ + " ".join(
        f"ASOF LEFT JOIN (SELECT * FROM filings WHERE concept = '{k}' AND value IS NOT NULL) f_{k} ON b.ticker = f_{k}.ticker AND b.date >= f_{k}.filed" for k in _CONCEPTS))
add("asof_lookup",
    lambda s, d: joins.asof_lookup(t.bars(s, d), t.filings(s, d).select("ticker", c("filed").alias("point_date")).distinct()).select(
        "ticker", c("point_date").alias("date"), rc("price", 2).alias("price")),
    f"""SELECT f.ticker, f.filed AS date, {r('b.close', 2)} AS price FROM (SELECT DISTINCT ticker, filed FROM filings) f
        ASOF LEFT JOIN bars b ON b.ticker = f.ticker AND f.filed >= b.date""")
add("interval_join", lambda s, d: joins.interval_join(t.bars(s, d).select("date", "ticker", "close"), t.membership(s, d)).select("date", "ticker", rc("close", 2).alias("close")),
    f"""SELECT date, ticker, {r('close', 2)} AS close FROM bars b WHERE EXISTS (SELECT 1 FROM membership m WHERE m.ticker = b.ticker
        AND b.date >= m.start AND b.date <= coalesce(m."end", b.date))""")
add("sector_join", lambda s, d: joins.sector_join(t.bars(s, d), t.sectors(s, d).where("sector <> 'ASIA'")).groupBy("sector", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")),
    """SELECT coalesce(s.sector, 'Other') AS sector, date, count(*) AS n, sum(volume) AS volume FROM bars b
       LEFT JOIN (SELECT * FROM sectors WHERE sector <> 'ASIA') s ON b.ticker = s.ticker GROUP BY 1, 2""")


def _calendar_join(s, d):
    out = joins.calendar_left_join(t.trading_calendar(s, d).select("date"), t.macro(s, d), ["date"])
    fwd = joins.calendar_left_join(t.trading_calendar(s, d).select("date"), t.macro(s, d).withColumnsRenamed({"T10Y2Y": "t_ff", "NFCI": "n_ff"}), ["date"], "forward")
    return out.join(fwd, "date").select("date", rc("T10Y2Y").alias("t"), rc("NFCI").alias("n"), rc("t_ff").alias("t_ff"), rc("n_ff").alias("n_ff"))


add("calendar_left_join", _calendar_join,
    f"""SELECT date, {r('T10Y2Y')} AS t, {r('NFCI')} AS n,
        {r('last_value(T10Y2Y IGNORE NULLS) OVER (ORDER BY date)')} AS t_ff, {r('last_value(NFCI IGNORE NULLS) OVER (ORDER BY date)')} AS n_ff
        FROM cal LEFT JOIN macro USING (date)""")
def _rolled(s, d):
    """Every observation of both series on the next trading day that is not a Friday."""
    long = t.macro(s, d).unpivot(["date"], ["T10Y2Y", "NFCI"], "series", "value").where("value IS NOT NULL")
    return joins.roll_to_trading_day(long, t.trading_calendar(s, d).where(F.dayofweek("date") != 6))


add("roll_to_trading_day", lambda s, d: _rolled(s, d).select("date", "series", rc("value").alias("value")),
    f"""SELECT c.date, m.series, {r('m.value')} AS value FROM (SELECT date, 'T10Y2Y' AS series, T10Y2Y AS value FROM macro WHERE T10Y2Y IS NOT NULL
        UNION ALL SELECT date, 'NFCI', NFCI FROM macro WHERE NFCI IS NOT NULL) m ASOF JOIN (SELECT * FROM cal WHERE isodow(date) <> 5) c ON m.date <= c.date""")
add("score_target_join",
    lambda s, d: joins.score_target_join(t.filing_scores(s, d).select("date", "ticker", "score"), _labels(s, d)).select("date", "ticker", rc("score").alias("score"), rc("target").alias("target")),
    f"SELECT date, ticker, {r('score')} AS score, {r('target')} AS target FROM pairs")


def _labels(s, d, h: int = 5):
    return xs.demean_target(xs.member_forward_return(t.bars_filled(s, d), h)).select("date", "ticker", "target")


add("latest_per_key", lambda s, d: joins.latest_per_key(t.ledger(s, d)).select("sleeve", "date", F.inline("decisions")).select("sleeve", "date", "asset", rc("target_weight").alias("target_weight")),
    f"""SELECT sleeve, date, asset, {r('target_weight')} AS target_weight FROM decisions d
        WHERE date = (SELECT max(date) FROM ledger l WHERE l.sleeve = d.sleeve) AND target_weight > 0""")


def _fold_ics(s, d, flip: bool):
    """Per quarter mean score-label product as a stand-in for per-fold rank correlations."""
    base = joins.score_target_join(t.filing_scores(s, d).select("date", "ticker", "score"), _labels(s, d))
    x = F.when(c("score") > 0, 1.0).otherwise(-1.0) if flip else c("score")
    fold = (F.year("date") * 4 + F.quarter("date")).cast("long")
    return base.groupBy(fold.alias("fold")).agg((F.avg(x * c("target"))).alias("ic"))


cte("fold_base", "SELECT year(date) * 4 + quarter(date) AS fold, avg(score * target) AS ic FROM pairs GROUP BY 1")
cte("fold_full", "SELECT year(date) * 4 + quarter(date) AS fold, avg(CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE -1 END * target) AS ic FROM pairs GROUP BY 1")
cte("paired", "SELECT b.fold, b.ic AS base, f.ic AS full_ic FROM fold_base b JOIN fold_full f ON b.fold = f.fold")
add("pair_folds", lambda s, d: joins.pair_folds(_fold_ics(s, d, False), _fold_ics(s, d, True)).select("fold", rc("base").alias("base"), rc("full").alias("full_ic")),
    f"SELECT fold::BIGINT AS fold, {r('base')} AS base, {r('full_ic')} AS full_ic FROM paired", dates="")
add("concat_panels",
    lambda s, d: b.concat_panels([
        t.bars(s, d).where(t.brand_number() <= 15).select("date", "ticker", "close"),
        t.bars(s, d).where(t.brand_number() >= 10).select("date", "ticker", (c("close") * 2).alias("close"))]).select("date", "ticker", rc("close", 2).alias("close")),
    f"SELECT date, b.ticker, {r('CASE WHEN num <= 15 THEN close ELSE 2 * close END', 2)} AS close FROM bars b JOIN names n ON b.ticker = n.ticker")

# --- filings and insiders ------------------------------------------------------------------------------------
cte("filing_long", "SELECT ticker, filed, concept, value, value / lag(value) OVER (PARTITION BY ticker, concept ORDER BY filed) - 1 AS growth FROM filings WHERE value IS NOT NULL")
add("filing_growth", lambda s, d: fund.filing_growth(t.filings(s, d)).select("ticker", "concept", "filed", rc("growth").alias("growth")),
    f"SELECT ticker, concept, filed, {r('growth')} AS growth FROM filing_long", dates="filed")
cte("filing_view", """SELECT w.*, CASE WHEN num % 3 = 0 THEN liabilities / 2 END AS debt,
    revenue / lag(revenue) OVER (PARTITION BY ticker ORDER BY filed) - 1 AS rg, net_income / lag(net_income) OVER (PARTITION BY ticker ORDER BY filed) - 1 AS ng FROM filing_wide w""")
cte("ratios", """SELECT b.date, b.ticker, net_income / nullif(close * shares, 0) AS earnings_yield, equity / nullif(close * shares, 0) AS book_to_price,
    revenue / nullif(close * shares, 0) AS sales_to_price, operating_income / nullif(close * shares, 0) AS fcf_proxy_yield,
    net_income / nullif(equity, 0) AS roe, gross_profit / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS op_margin,
    coalesce(debt, liabilities) / nullif(equity, 0) AS debt_to_equity, rg AS rev_growth_yoy, ng AS ni_growth_yoy
    FROM filled b ASOF LEFT JOIN filing_view f ON b.ticker = f.ticker AND b.date >= f.filed""")
add("fundamental_ratios",
    lambda s, d: fund.fundamental_ratios(t.bars_filled(s, d), t.filings(s, d)).select("date", "ticker", *[rc(x).alias(x) for x in fund.FUNDAMENTAL_COLS]),
    "SELECT date, ticker, " + ", ".join(f"{r(x)} AS {x}" for x in fund.FUNDAMENTAL_COLS) + " FROM ratios")
add("daily_insider_flow", lambda s, d: fund.daily_insider_flow(t.insider_tx(s, d)).select("ticker", "date", rc("signed_value", 4).alias("signed_value"), c("purchases").cast("long").alias("purchases")),
    f"SELECT ticker, filed AS date, {r('sum(signed_value)', 4)} AS signed_value, sum(is_purchase)::BIGINT AS purchases FROM insider GROUP BY 1, 2")
cte("flow", "SELECT ticker, filed AS date, sum(signed_value) AS sv, sum(is_purchase) AS np FROM insider GROUP BY 1, 2")
cte("insider_ft", f"""SELECT b.date, b.ticker, sum(coalesce(np, 0)) OVER (w ROWS 89 PRECEDING)::DOUBLE AS insider_buy_count_90d,
    sum(coalesce(sv, 0)) OVER (w ROWS 89 PRECEDING) / (sum(abs(coalesce(sv, 0))) OVER (w ROWS 364 PRECEDING) + 1) AS insider_net_buy_norm
    FROM filled b LEFT JOIN flow f ON b.ticker = f.ticker AND b.date = f.date WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)""".replace("(w ROWS", "(PARTITION BY b.ticker ORDER BY b.date ROWS").split(" WINDOW")[0])
add("insider_features", lambda s, d: fund.insider_features(t.bars_filled(s, d), t.insider_tx(s, d)).select("date", "ticker", "insider_buy_count_90d", rc("insider_net_buy_norm").alias("insider_net_buy_norm")),
    f"SELECT date, ticker, insider_buy_count_90d, {r('insider_net_buy_norm')} AS insider_net_buy_norm FROM insider_ft")
add("rank_fill_neutral",
    lambda s, d: xs.rank_fill_neutral(fund.fundamental_ratios(t.bars_filled(s, d), t.filings(s, d)), ["roe", "debt_to_equity"], "f_", t.n_names(s, d)).select("date", "ticker", rc("f_roe").alias("f_roe"), rc("f_debt_to_equity").alias("f_debt_to_equity")),
    f"SELECT date, ticker, {r('coalesce(' + pct_sql('roe') + ' - 0.5, 0)')} AS f_roe, {r('coalesce(' + pct_sql('debt_to_equity') + ' - 0.5, 0)')} AS f_debt_to_equity FROM ratios")

# --- cross-section -------------------------------------------------------------------------------------------
add("cs_rank", lambda s, d: t.filing_scores(s, d).select("date", "ticker", rc(xs.cs_rank("score")).alias("rank")),
    f"SELECT date, ticker, {r(pct_sql('score') + ' - 0.5')} AS rank FROM scored")
add("cs_rank_ties", lambda s, d: t.bars(s, d).select("date", "ticker", rc(xs.cs_rank("volume")).alias("rank")),
    f"SELECT date, ticker, {r(pct_sql('volume') + ' - 0.5')} AS rank FROM bars")
add("cs_rank_split",
    lambda s, d: rank_split(t.table(s, d, "lineitem").select("l_linenumber", "l_returnflag", "l_extendedprice"), {"pct": "l_extendedprice"}, ["l_returnflag"], []).groupBy("l_returnflag", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), rc(F.avg("pct"), 8).alias("pct"), rc(F.max("pct"), 8).alias("top")),
    f"""SELECT l_returnflag, l_linenumber, count(*) AS n, {r('avg(p)', 8)} AS pct, {r('max(p)', 8)} AS top FROM (
        SELECT l_returnflag, l_linenumber, {pct_sql('l_extendedprice', 'l_returnflag')} AS p FROM lineitem) GROUP BY 1, 2""", dates="")
add("sector_rank", lambda s, d: joins.sector_join(t.filing_scores(s, d), t.sectors(s, d)).select("date", "ticker", "sector", rc(xs.sector_rank("score")).alias("rank")),
    f"SELECT date, ticker, sector, {r(pct_sql('score', 'date, sector') + ' - 0.5')} AS rank FROM (SELECT s.*, sector FROM scored s JOIN sectors k ON s.ticker = k.ticker)")
add("winsorize", lambda s, d: xs.winsorize(t.filing_scores(s, d).select("date", "ticker", "score", "volume"), ["score", "volume"], 0.05, names=t.n_names(s, d)).select("date", "ticker", rc("score").alias("score"), rc("volume").alias("volume")),
    "SELECT date, ticker, " + ", ".join(f"{r(f'CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, hi_{x}), lo_{x}) END')} AS {x}" for x in ("score", "volume")) + """ FROM
        (SELECT s.date, s.ticker, s.score, s.volume, hi_score, lo_score, hi_volume, lo_volume FROM scored s JOIN (SELECT date, quantile_cont(score, 0.05) AS lo_score, quantile_cont(score, 0.95) AS hi_score, quantile_cont(volume, 0.05) AS lo_volume,
         quantile_cont(volume, 0.95) AS hi_volume FROM scored GROUP BY 1) q ON s.date = q.date)""")
add("forward_return", lambda s, d: xs.member_forward_return(t.bars_filled(s, d), 5, t.membership(s, d)).select("date", "ticker", rc("fwd").alias("fwd")),
    f"""SELECT date, ticker, {r('fwd')} AS fwd FROM labels b WHERE EXISTS (SELECT 1 FROM membership m WHERE m.ticker = b.ticker
        AND b.date >= m.start AND b.date <= coalesce(m."end", b.date))""")
add("label_self_join", lambda s, d: add_features(t.bars_filled(s, d), [xs.forward_return(20)]).select("date", "ticker", rc("fwd").alias("fwd")),
    f"WITH lsj AS MATERIALIZED (SELECT date, pos, ticker, close FROM filled) SELECT a.date, a.ticker, {r('b.close / a.close - 1')} AS fwd FROM lsj a LEFT JOIN lsj b ON a.ticker = b.ticker AND b.pos = a.pos + 20")
add("demean_target", lambda s, d: _labels(s, d).select("date", "ticker", rc("target").alias("target")),
    f"SELECT date, ticker, {r('target')} AS target FROM labels")
add("demean_target_sector",
    lambda s, d: xs.demean_target(joins.sector_join(xs.member_forward_return(t.bars_filled(s, d), 5), t.sectors(s, d)), ["date", "sector"]).select("date", "ticker", rc("target").alias("target")),
    f"SELECT date, l.ticker, {r('fwd - avg(fwd) OVER (PARTITION BY date, sector)')} AS target FROM labels l JOIN sectors k ON l.ticker = k.ticker")
cte("bases", f"""SELECT f.date, f.ticker, ln(f.close) - ln(lag(f.close, 20) OVER w) AS mom, ({roll('stddev_samp', 'r1', 20, 'PARTITION BY f.ticker ORDER BY f.date')}) * sqrt(252) AS v20,
    ({roll('stddev_samp', 'r1', 60, 'PARTITION BY f.ticker ORDER BY f.date')}) * sqrt(252) AS v60,
    (f.close / b.close) / lag(f.close / b.close, 60) OVER w - 1 AS rs, f.volume * f.close AS liq,
    CASE WHEN count(f.close) OVER (w ROWS 39 PRECEDING) = 40 THEN regr_r2(ln(f.close), i) OVER (w ROWS 39 PRECEDING) END AS r2
    FROM px2 f JOIN bench b ON f.date = b.date""".replace("OVER (w ROWS", "OVER (PARTITION BY f.ticker ORDER BY f.date ROWS").replace("OVER w", "OVER (PARTITION BY f.ticker ORDER BY f.date)"))


def _ranked(s, d, sector: bool):
    from ..operators.relative import market_join, relative_strength_column
    base = market_join(t.bars_filled(s, d), t.benchmark(s, d).select("date", c("close").alias("_bench")))
    p = add_features(base, [tech.log_momentum(20), tech.realized_vol(20), tech.realized_vol(60), tech.trend(), relative_strength_column("rs_bench", "_bench")])
    if sector:
        p = joins.sector_join(p, t.sectors(s, d))
    out = xs.add_ranked_signals(p, sector, t.n_names(s, d))
    return out.select("date", "ticker", *[rc(k).alias(k) for k in xs.ranked_signals()])


_sig = {"csrank_mom": "mom", "csrank_vol": "v20", "csrank_rs": "rs", "csrank_liquidity": "liq", "csrank_quality": "q"}
cte("bases_q", "SELECT k.*, -coalesce(v60, 0) + coalesce(r2, 0) AS q, sector FROM bases k JOIN sectors s ON k.ticker = s.ticker")
add("ranked_signals", lambda s, d: _ranked(s, d, False), "SELECT date, ticker, " + ", ".join(f"{r(pct_sql(v) + ' - 0.5')} AS {k}" for k, v in _sig.items()) + " FROM bases_q")
add("ranked_signals_sector", lambda s, d: _ranked(s, d, True), "SELECT date, ticker, " + ", ".join(f"{r(pct_sql(v, 'date, sector') + ' - 0.5')} AS {k}" for k, v in _sig.items()) + " FROM bases_q")


def _horizon_scores(s, d):
    p = add_features(t.bars_filled(s, d), [tech.log_momentum(60), tech.log_momentum(20)])
    return p.unpivot(["date", "ticker"], ["mom_60", "mom_20"], "h", "score").select(
        "date", "ticker", F.substring("h", 5, 2).cast("int").alias("horizon"), "score")


add("blend_horizons",
    lambda s, d: xs.blend_horizons(_horizon_scores(s, d).where("score IS NOT NULL"), {60: 0.75, 20: 0.25}).select("date", "ticker", rc("score").alias("score")),
    f"""SELECT date, ticker, {r('coalesce(0.75 * (' + pct_sql('m60') + ' - 0.5), 0) + 0.25 * (' + pct_sql('m20') + ' - 0.5)')} AS score FROM (
        SELECT date, ticker, ln(close) - ln(lag(close, 60) OVER ({W})) AS m60, ln(close) - ln(lag(close, 20) OVER ({W})) AS m20 FROM filled) WHERE m20 IS NOT NULL""")
cte("picked", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rn, row_number() OVER (PARTITION BY date ORDER BY score, ticker DESC) AS rb, count(*) OVER (PARTITION BY date) AS n FROM scored WHERE score IS NOT NULL")
add("top_quantile", lambda s, d: xs.top_quantile(t.filing_scores(s, d), 0.3).select("date", "ticker", c("pick").cast("long").alias("pick")),
    "SELECT date, ticker, rn AS pick FROM picked WHERE rn <= greatest(ceil(n * 0.3), 1)")
add("long_short_legs", lambda s, d: xs.long_short_legs(t.filing_scores(s, d), 0.3).select("date", "ticker", rc("weight").alias("weight")),
    f"""SELECT date, ticker, {r('CASE WHEN rn <= k THEN 0.5 / k ELSE 0 END - CASE WHEN rb <= k THEN 0.5 / k ELSE 0 END')} AS weight FROM (
        SELECT *, greatest(ceil(n * 0.3), 1)::DOUBLE AS k FROM picked) WHERE n >= 4 AND (rn <= k OR rb <= k)""")
cte("overlay_a", f"SELECT date, ticker, greatest(1 + ({pct_sql('score')} - 0.5), 0) AS w0 FROM scored WHERE score IS NOT NULL")
cte("overlay_b", "SELECT date, ticker, least(w0 / sum(w0) OVER (PARTITION BY date), 0.05) AS w1 FROM overlay_a")
add("overlay_weights", lambda s, d: xs.overlay_weights(t.filing_scores(s, d).select("date", "ticker", "score"), 1.0, 0.05).select("date", "ticker", rc("weight").alias("weight")),
    f"SELECT date, ticker, {r('w1 / sum(w1) OVER (PARTITION BY date)')} AS weight FROM overlay_b")


def _graduated(s, d):
    p = t.filing_scores(s, d).where("score IS NOT NULL").select("date", "ticker", F.lit(1.0).alias("weight"), (xs.rank_pct("score") * 100).alias("pct"))
    return xs.graduated_size(p).select("date", "ticker", rc("weight").alias("weight"))


cte("grad_a", f"SELECT date, ticker, round(100 * ({pct_sql('score')}), 9) AS p FROM scored WHERE score IS NOT NULL")
cte("grad_b", "SELECT date, ticker, CASE WHEN p < 40 THEN 0 WHEN p < 60 THEN 0.3 WHEN p < 80 THEN 0.7 ELSE 1 END::DOUBLE AS m FROM grad_a")
add("graduated_size", _graduated, f"SELECT date, ticker, {r('m / sum(m) OVER (PARTITION BY date)')} AS weight FROM grad_b WHERE m > 0")
_factors = {"trend_strength": f"close / avg(close) OVER ({W} ROWS 199 PRECEDING) - 1", "momentum": f"close / lag(close, 59) OVER ({W}) - 1",
            "low_volatility": f"-stddev_samp(r1) OVER ({W} ROWS 19 PRECEDING)", "liquidity": f"ln(1 + avg(close * volume) OVER ({W} ROWS 19 PRECEDING))"}
cte("factors", "SELECT date, pos, ticker, " + ", ".join(f"{e} AS {k}" for k, e in _factors.items()) + ", CASE WHEN i > 5 THEN r1 END AS expected_value FROM px2")
cte("asset_scores", "SELECT date, pos, ticker, " + ", ".join(f"CASE WHEN pos < 59 THEN 50 ELSE coalesce(100 * ({pct_sql(k)}), 50) END AS {k}" for k in xs.SCORE_WEIGHTS) + " FROM factors")
_comp = " + ".join(f"{v} * {k}" for k, v in xs.SCORE_WEIGHTS.items())


def _score_assets(s, d):
    filled = t.bars_filled(s, d)
    ev = filled.select("date", "ticker", F.when(F.row_number().over(series()) > 5, c("close") / F.lag("close").over(series()) - 1).alias("ev"))
    return xs.score_assets(filled, ev)


add("score_assets", lambda s, d: _score_assets(s, d).select("date", "ticker", *[rc(x, 4).alias(x) for x in (*xs.SCORE_WEIGHTS, "composite")]),
    "SELECT date, ticker, " + ", ".join(f"{r(x, 4)} AS {x}" for x in xs.SCORE_WEIGHTS) + f", {r(_comp, 4)} AS composite FROM asset_scores")

# --- sets ------------------------------------------------------------------------------------------------------
add("union_calendar", lambda s, d: b.union_calendar(t.trading_calendar(s, d), t.macro(s, d), t.ledger(s, d)),
    "SELECT date FROM cal UNION SELECT date FROM macro UNION SELECT date FROM ledger")
add("union_tickers", lambda s, d: b.union_tickers(t.tickers(s, d), t.table(s, d, "part").select(c("p_type").alias("ticker"))),
    "SELECT ticker FROM names UNION SELECT p_type FROM part", dates="")
add("union_all_books",
    lambda s, d: t.ledger(s, d).where("day_return < 0").select("date", "sleeve", F.lit("losers").alias("book")).unionByName(
        t.ledger(s, d).where("n_positions > 3").select("date", "sleeve", F.lit("wide").alias("book"))),
    "SELECT date, sleeve, 'losers' AS book FROM ledger WHERE day_return < 0 UNION ALL SELECT date, sleeve, 'wide' FROM ledger WHERE n_positions > 3")
