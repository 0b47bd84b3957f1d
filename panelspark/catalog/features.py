"""Queries over the per-ticker features, breadth, relative strength and regimes."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scan import ewm_scan, number_rows
from ..functions.windows import add_features
from ..operators import relative, technical as tech
from ..sources import tables as t
from .base import add, cte, r, rc

W = "PARTITION BY ticker ORDER BY date"


def roll(agg: str, x: str, n: int, part: str = W) -> str:
    f = f"OVER ({part} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {f} = {n} THEN {agg}({x}) {f} END"


def ewm_ctes(stem: str, src: str, xs: dict[str, tuple[str, float]]) -> str:
    """Three CTEs: the inputs, their ordinals, the running sums; the last one is named ``stem``."""
    a = ", ".join(f"{x} AS x_{k}" for k, (x, _) in xs.items())
    b = ", ".join(f"count(x_{k}) OVER ({W}) AS n_{k}" for k in xs)
    parts = []
    for k, (_, alpha) in xs.items():
        rate = repr(-math.log1p(-alpha))
        parts.append(
            f"CASE WHEN n_{k} > 0 THEN exp(-{rate} * n_{k}) * sum(CASE WHEN n_{k} = 1 THEN 1.0::DOUBLE ELSE {alpha!r} END"
            f" * x_{k} * exp({rate} * n_{k})) OVER ({W}) END AS {k}"
        )
    cte(f"{stem}_a", f"SELECT *, {a} FROM {src}")
    cte(f"{stem}_b", f"SELECT *, {b} FROM {stem}_a")
    cte(stem, f"SELECT *, {', '.join(parts)} FROM {stem}_b")
    return stem


# long series with a stretch without values that is longer than a block of the closed form
SPARSE = "CASE WHEN date <= 3000 OR date > 14000 AND date % 3 = 0 THEN v END"
cte("sparse", """SELECT l_returnflag AS ticker, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS date FROM lineitem""")
cte("ews_n", f"SELECT *, count(x) OVER ({W}) AS n FROM (SELECT *, {SPARSE} AS x FROM sparse)")
# the closed form starts anew every 20,000 known values: exp of more than about 70,000 of them is infinite
RATE = repr(-math.log1p(-0.01))
cte("ews_s", f"""SELECT *, exp(-{RATE} * m) AS w, exp(-{RATE} * m) * sum(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.01 END * x * exp({RATE} * m))
    OVER (PARTITION BY ticker, seg ORDER BY date) AS s
    FROM (SELECT *, greatest(n - 1, 0) // 20000 AS seg, greatest(n - 1, 0) % 20000 + 1 AS m FROM ews_n)""")


def ewm_sparse(spark, d):
    """Three series that hold all line items: both the ordinals and the means are scans over blocks."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = number_rows(spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", *order), ["l_returnflag"], order, "date")
    rows = rows.select(F.col("l_returnflag").alias("ticker"), "date", F.col("l_quantity").cast("double").alias("v")).withColumn("x", F.expr(SPARSE))
    return ewm_scan(rows, ["ticker"], ["date"], "x", 0.01, "mean").select("ticker", "date", rc("mean").alias("mean"))


add("ewm_sparse", ewm_sparse,
    f"""WITH RECURSIVE ends AS (SELECT ticker, seg, arg_max(s, date) AS s, arg_max(w, date) AS w FROM ews_s GROUP BY 1, 2),
        into_next AS (
            SELECT ticker, seg + 1 AS seg, s AS y FROM ends WHERE seg = 0
            UNION ALL SELECT e.ticker, e.seg + 1, e.s + e.w * i.y FROM into_next i JOIN ends e ON e.ticker IS NOT DISTINCT FROM i.ticker AND e.seg = i.seg)
        SELECT a.ticker, a.date, {r('a.s + coalesce(a.w * i.y, 0)')} AS mean
        FROM ews_s a LEFT JOIN into_next i ON a.ticker IS NOT DISTINCT FROM i.ticker AND a.seg = i.seg""", dates="")

cte("px", f"""SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, row_number() OVER w AS i
    FROM filled WINDOW w AS ({W})""")
cte("px2", """SELECT *, close / pc - 1 AS r1, coalesce(greatest(high - low, abs(high - pc), abs(low - pc)), high - low) AS tr,
    high - ph AS up, pl - low AS dn FROM px""")
A14 = 1 / 14
ewm_ctes("ewa", "px2", {
    "atr14": ("tr", A14),
    "epl": ("CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0::DOUBLE END", A14),
    "emi": ("CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0::DOUBLE END", A14),
    "atr10": ("tr", 0.1),
    "ema20": ("close", 2 / 21),
    "gain": ("CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END", A14),
    "loss": ("CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END", A14),
})
ewm_ctes("ewd", "ewa", {"adx": (
    "100 * abs(100 * epl / nullif(atr14, 0) - 100 * emi / nullif(atr14, 0)) / nullif(100 * epl / nullif(atr14, 0) + 100 * emi / nullif(atr14, 0), 0)", A14)})


def wma_sql(x: str, n: int) -> str:
    return "(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER ({W})" for k in range(n)) + f") / {n * (n + 1) / 2}"


cte("hull_a", f"SELECT *, 2 * ({wma_sql('close', 10)}) - ({wma_sql('close', 20)}) AS hraw FROM filled")
cte("hull", f"SELECT *, {wma_sql('hraw', 4)} AS hma FROM hull_a")
cte("kama_a", f"SELECT *, abs(close - lag(close, 10) OVER ({W})) AS ck, {roll('sum', 'abs(close - pc)', 10)} AS vol FROM px")
F2, S30 = 2 / 3, 2 / 31
cte("kama_b", f"SELECT *, pow(coalesce(ck / nullif(vol, 0), 0) * {F2 - S30!r} + {S30!r}, 2) AS g FROM kama_a")
cte("kama_c", f"SELECT *, sum(CASE WHEN i > 1 THEN -ln(1 - g) ELSE 0 END) OVER ({W}) AS acc FROM kama_b")
cte("kama", f"SELECT *, exp(-acc) * sum(CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE g END * close * exp(acc)) OVER ({W}) AS kma FROM kama_c")
cte("band", f"""SELECT *, lag((high + low) / 2 + 3 * atr10) OVER ({W}) AS ub, lag((high + low) / 2 - 3 * atr10) OVER ({W}) AS lb FROM ewa""")
cte("obv_a", f"SELECT *, sum(coalesce(sign(close - pc), 0) * volume) OVER ({W}) AS raw FROM px")
cte("mv", f"SELECT *, {roll('avg', 'volume', 10)} AS v10 FROM filled")
cte("sd20", f"SELECT *, {roll('stddev_samp', 'r1', 20)} AS sd FROM px2")
cte("yz", """SELECT *, ln(high/open) * (ln(high/open) - ln(close/open)) + ln(low/open) * (ln(low/open) - ln(close/open)) AS rs,
    ln(open/pc) AS oc, ln(close/pc) AS cc FROM px""")
K = 0.34 / (1.34 + 21 / 19)

cte("win60", f"SELECT *, list(close) OVER ({W} ROWS 59 PRECEDING) AS win FROM filled")


def feature(name: str, levels, expr: str, src: str, extra: dict[str, str] | None = None, digits: int = 6):
    outs = {name: expr, **(extra or {})}

    def fn(spark, d):
        df = add_features(t.bars_filled(spark, d), levels())
        return df.select("date", "ticker", *[rc(o, digits).alias(o) for o in outs])

    sql = f"SELECT date, ticker, {', '.join(r(e, digits) + ' AS ' + o for o, e in outs.items())} FROM {src}"
    add(name, fn, sql)


feature("momentum", lambda: [tech.momentum(20, "momentum")], f"close / lag(close, 20) OVER ({W}) - 1", "filled")
_mom = {f"mom_{w}": f"ln(close) - ln(lag(close, {w}) OVER ({W}))" for w in (5, 10, 20, 40, 60, 120)}
add("log_momentum",
    lambda s, d: add_features(t.bars_filled(s, d), [tech.log_momentum(w) for w in (5, 10, 20, 40, 60, 120)])
    .select("date", "ticker", *[rc(k).alias(k) for k in _mom]),
    f"SELECT date, ticker, {', '.join(r(e) + ' AS ' + k for k, e in _mom.items())} FROM filled")
feature("true_range", lambda: [tech.true_range()], "tr", "px2")
feature("wma_20", lambda: [tech.wma(20)], wma_sql("close", 20), "filled", digits=4)
feature("hull_dist", lambda: [tech.hull_dist()], "(close - hma) / nullif(hma, 0)", "hull")
feature("adx", lambda: [tech.adx()], "adx", "ewd")
feature("kama_dist", lambda: [tech.kama_dist()], "(close - kma) / kma", "kama")
feature("supertrend", lambda: [tech.supertrend()],
        f"coalesce(last_value(CASE WHEN close > ub THEN 1.0::DOUBLE WHEN close < lb THEN -1.0::DOUBLE END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 1)", "band")
feature("trend_slope", lambda: [tech.trend()], roll("1 * count", "close", 40).replace(
    "1 * count(close)", "252 * regr_slope(ln(close), i)"), "px")
feature("trend_r2", lambda: [tech.trend()], roll("1 * count", "close", 40).replace(
    "1 * count(close)", "regr_r2(ln(close), i)"), "px")
feature("rel_volume", lambda: [tech.rel_volume()], f"volume / ({roll('avg', 'volume', 20)})", "filled")
feature("obv_z", lambda: [tech.obv_z()], f"(raw - ({roll('avg', 'raw', 60)})) / ({roll('stddev_samp', 'raw', 60)})", "obv_a")
feature("cmf", lambda: [tech.cmf()],
        f"({roll('sum', '(((close-low)-(high-close)) / nullif(high-low,0) * volume)', 20)}) / ({roll('sum', 'volume', 20)})", "filled")
feature("vwap_dist", lambda: [tech.vwap_dist()],
        f"close / (({roll('sum', '((high+low+close)/3*volume)', 20)}) / ({roll('sum', 'volume', 20)})) - 1", "filled")
feature("vol_accel", lambda: [tech.vol_accel()], f"v10 / lag(v10, 10) OVER ({W}) - 1", "mv")
feature("atr_pct", lambda: [tech.atr_pct()], "atr14 / close", "ewa")
add("realized_vol",
    lambda s, d: add_features(t.bars_filled(s, d), [tech.realized_vol(w) for w in (10, 20, 60)])
    .select("date", "ticker", *[rc(f"realized_vol_{w}").alias(f"realized_vol_{w}") for w in (10, 20, 60)]),
    "SELECT date, ticker, " + ", ".join(
        f"{r('(' + roll('stddev_samp', 'r1', w) + ') * sqrt(252)')} AS realized_vol_{w}" for w in (10, 20, 60)) + " FROM px2")
feature("vol_of_vol", lambda: [tech.vol_of_vol()], f"({roll('stddev_samp', 'sd', 20)}) * sqrt(252)", "sd20")
feature("parkinson_vol", lambda: [tech.parkinson_vol()], f"sqrt(({roll('avg', 'pow(ln(high/low),2)', 20)}) / (4 * ln(2)) * 252)", "filled")
feature("yang_zhang_vol", lambda: [tech.yang_zhang_vol()],
        f"sqrt(252 * (({roll('var_samp', 'oc', 20)}) + {K!r} * ({roll('var_samp', 'cc', 20)}) + {1 - K!r} * ({roll('avg', 'rs', 20)})))", "yz")
feature("bollinger_z", lambda: [tech.bollinger_z(name="bollinger_z")],
        f"(close - ({roll('avg', 'close', 20)})) / ({roll('stddev_samp', 'close', 20)})", "filled")
feature("ema_dist", lambda: [tech.ema_dist()], "(close - ema20) / ema20", "ewa")
feature("pct_rank_60", lambda: [tech.pct_rank()],
        "CASE WHEN len(win) = 60 THEN len(list_filter(win, lambda y: y < close)) / 60 END", "win60")
feature("rsi", lambda: [tech.rsi()], "100 - 100 / (1 + gain / nullif(loss, 0))", "ewa")

# --- market-wide -----------------------------------------------------------------------------------
cte("above", "SELECT date, " + ", ".join(
    f"coalesce(close > ({roll('avg', 'close', n)}), false)::INT AS a{n}" for n in (20, 50, 200))
    + f", coalesce(close >= ({roll('max', 'close', 252)}), false)::INT AS nh, coalesce(close <= ({roll('min', 'close', 252)}), false)::INT AS nl FROM filled")
_B = {"breadth_pct_above_20": "a20", "breadth_pct_above_50": "a50", "breadth_pct_above_200": "a200"}
_N = "(SELECT count(*) FROM names)"
cte("breadth", "SELECT date, " + ", ".join(
    f"sum({v}) / {_N} AS {k}" for k, v in {**_B, "breadth_new_highs": "nh", "breadth_new_lows": "nl"}.items())
    + " FROM above GROUP BY date")
add("breadth_above_ma",
    lambda s, d: relative.breadth(t.bars_filled(s, d)).select("date", *[rc(k).alias(k) for k in _B]),
    "SELECT date, " + ", ".join(f"{r(k)} AS {k}" for k in _B) + " FROM breadth")
add("new_highs_lows",
    lambda s, d: relative.breadth(t.bars_filled(s, d)).select(
        "date", rc("breadth_new_highs").alias("breadth_new_highs"), rc("breadth_new_lows").alias("breadth_new_lows")),
    f"SELECT date, {r('breadth_new_highs')} AS breadth_new_highs, {r('breadth_new_lows')} AS breadth_new_lows FROM breadth")
add("relative_strength",
    lambda s, d: relative.relative_strength(t.bars_filled(s, d), t.references(s, d)).select(
        "date", "ticker", "ref", rc("rs").alias("rs")),
    f"""SELECT date, ticker, ref, {r('q / lag(q, 60) OVER (PARTITION BY ticker, ref ORDER BY date) - 1')} AS rs FROM (
        SELECT f.date, ticker, ref, f.close / x.close AS q FROM filled f JOIN refs x ON f.date = x.date)""")
cte("beta_in", f"""SELECT f.date, f.ticker, f.close / lag(f.close) OVER (PARTITION BY f.ticker ORDER BY f.date) - 1 AS br,
    b.close / lag(b.close) OVER (PARTITION BY f.ticker ORDER BY f.date) - 1 AS bm FROM filled f JOIN bench b ON f.date = b.date""")
add("rolling_beta",
    lambda s, d: relative.rolling_beta(t.bars_filled(s, d), t.benchmark(s, d)).select("date", "ticker", rc("beta").alias("beta")),
    f"""SELECT date, ticker, {r(f"CASE WHEN count(br) OVER w = 60 THEN covar_samp(br, bm) OVER w / nullif(var_samp(bm) OVER w, 0) END")} AS beta
        FROM beta_in WINDOW w AS ({W} ROWS 59 PRECEDING)""")
add("market_join",
    lambda s, d: relative.market_join(
        t.bars_filled(s, d).select("date", "ticker", "close"),
        t.benchmark(s, d).select("date", F.col("close").alias("bench"))).select(
        "date", "ticker", rc(F.col("close") / F.col("bench")).alias("rel")),
    f"SELECT f.date, ticker, {r('f.close / b.close')} AS rel FROM filled f LEFT JOIN bench b ON f.date = b.date")
