"""Queries that run the ledger through Structured Streaming, the user-function surface and the panel."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import evaluate as ev
from ..plans.panel import PanelConfig, build_panel
from ..session import stored
from ..sources import tables as t
from ..streaming import ledger_streams as ls
from .base import add, cte, r, rc
from .features import W
from .relational import pct_sql, scratch

c = F.col


def landed(s, d, order: str = "abc") -> str:
    """Ledger rows landing as JSON files, a third of the month each, in the given order; a part may come twice."""
    folder = scratch(s, "landing")
    rows = t.ledger(s, d)
    parts = {"a": ("2000-01-01", "2024-01-11"), "b": ("2024-01-11", "2024-01-21"), "c": ("2024-01-21", "2100-01-01")}
    for lo, hi in (parts[x] for x in order):
        rows.where((c("date") >= lo) & (c("date") < hi)).coalesce(1).write.mode("append").json(folder)
    return folder


def streamed(s, d, transform, mode: str = "append", files: int | None = 1, stateful: bool = False) -> str:
    if stateful:
        ls.use_rocksdb(s)
    out = scratch(s, "stream")
    ls.run_available(transform(ls.ledger_stream(s, landed(s, d), files)), out, out + "_checkpoint", mode)
    return out


def _append(s, d, order: str, kind: str):
    ls.use_rocksdb(s)
    table = scratch(s, "ledger_table")
    ls.stream_ledger_append(s, landed(s, d, order), table, table + "_checkpoint", files_per_batch=1)
    return ls.read_appended(s, table, kind)


add("stream_ledger_append", lambda s, d: _append(s, d, "abbc", "new").select("date", "sleeve", rc("day_return", 14).alias("day_return"), "n_positions"),
    f"SELECT date, sleeve, {r('day_return', 14)} AS day_return, n_positions FROM ledger")
# the middle part comes last: too late for the ledger, but counted; what is sent again is neither
add("stream_late_rows", lambda s, d: _append(s, d, "acab", "late").groupBy("sleeve").agg(F.count(F.lit(1)).alias("n"), rc(F.sum("day_return"), 10).alias("total")),
    f"SELECT sleeve, count(*) AS n, {r('sum(day_return)', 10)} AS total FROM ledger WHERE date >= DATE '2024-01-11' AND date < DATE '2024-01-21' GROUP BY 1", dates="")
add("stream_governor", lambda s, d: s.read.parquet(streamed(s, d, ls.stream_governor, stateful=True)).select("sleeve", "date", "exposure", "reason"),
    "SELECT strategy AS sleeve, date, CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0 END AS exposure, reason FROM gvl")
add("stream_page_hinkley",
    lambda s, d: s.read.parquet(streamed(s, d, ls.stream_page_hinkley, stateful=True)).select("sleeve", "date", rc("rise", 8).alias("rise"), rc("fall", 8).alias("fall"), "alarm"),
    f"SELECT sleeve, date, {r('rise', 8)} AS rise, {r('fall', 8)} AS fall, alarm FROM ph")
_ST = ["cum_return", "sharpe", "best_day", "worst_day", "win_rate"]
add("stream_standings",
    lambda s, d: ls.latest_by_batch(s, streamed(s, d, ls.stream_standings, "update")).select("sleeve", "n_days", *[rc(x, 8).alias(x) for x in _ST], "last_date", "last_positions"),
    f"SELECT sleeve, n_days, {', '.join(f'{r(x, 8)} AS {x}' for x in _ST)}, last_date, last_positions FROM stand", dates="last_date")
add("stream_period_rollup",
    lambda s, d: s.read.parquet(streamed(s, d, ls.stream_period_rollup)).select("period", "sleeve", rc("ret", 8).alias("ret")),
    f"""SELECT period, sleeve, {r('exp(sum(ln(1 + day_return))) - 1', 8)} AS ret FROM (SELECT *, cast(date_trunc('week', date) AS DATE) AS period FROM ledger)
        WHERE period + INTERVAL 7 DAY <= (SELECT max(date) FROM ledger) - INTERVAL 1 DAY GROUP BY 1, 2""", dates="period")

# --- user functions ----------------------------------------------------------------------------------------------
def mean_deviation(windows):
    return abs(windows - windows.mean(axis=1, keepdims=True)).mean(axis=1)


add("rolling_apply",
    lambda s, d: udfs.rolling_apply(t.bars_filled(s, d).select("date", "ticker", "close"), mean_deviation, "close", 10, "mad").select("date", "ticker", rc("mad", 4).alias("mad")),
    f"""SELECT date, ticker, {r('CASE WHEN len(w) = 10 THEN list_avg(list_transform(w, lambda x: abs(x - list_avg(w)))) END', 4)} AS mad FROM (
        SELECT date, ticker, list(close) OVER ({W} ROWS 9 PRECEDING) AS w FROM filled)""")
add("per_date",
    lambda s, d: udfs.per_date(t.bars(s, d).select("date", "ticker", "close"), lambda p: p.assign(gap=p["close"] / p["close"].median() - 1)[["date", "ticker", "gap"]], "date date, ticker string, gap double").select("date", "ticker", rc("gap").alias("gap")),
    f"SELECT b.date, ticker, {r('close / m - 1')} AS gap FROM bars b JOIN (SELECT date, median(close) AS m FROM bars GROUP BY 1) q ON b.date = q.date")
add("per_ticker",
    lambda s, d: udfs.per_ticker(t.bars_filled(s, d).select("date", "ticker", "close"), lambda p: p.assign(e=p["close"].ewm(alpha=0.1, adjust=False).mean())[["date", "ticker", "e"]], "date date, ticker string, e double").select("date", "ticker", rc("e", 4).alias("ewm")),
    f"SELECT date, ticker, {r('exp(-0.10536051565782628 * n) * sum(CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.1 END * close * exp(0.10536051565782628 * n)) OVER (PARTITION BY ticker ORDER BY date)', 4)} AS ewm FROM (SELECT *, row_number() OVER ({W}) AS n FROM filled)")

# --- the composed panel ----------------------------------------------------------------------------------------------


def full_panel(s, d, **options):
    """The panel of all inputs; days of one trade get a range, without which money flow has no value anywhere."""
    wide = t.bars_filled(s, d).withColumns({"high": c("high") * 1.01, "low": c("low") * 0.99})
    bars = stored(s, wide, "bars")  # read several times: the trades are joined and sorted once
    return build_panel(bars, t.price_level(bars), PanelConfig(**options), refs=stored(s, t.references(s, d), "refs"), ref_names=("PROMO", "SMALL"),
                       sectors=t.sectors(s, d), membership=t.membership(s, d), filings=t.filings(s, d), insider=t.insider_tx(s, d))


#: features of the panel that have SQL of their own; every feature decides which rows are complete
_PANEL = {"mom_20": "mom20", "mom_60": "mom60", "rel_volume": "rv", "boll_z": "bz", "realized_vol_20": "v20", "csrank_mom": "rk_mom", "csrank_vol": "rk_vol", "csrank_rs": "rk_rs",
          "csrank_liquidity": "rk_liq", "csrank_quality": "rk_q"}
cte("bp_label", """SELECT *, fwd - avg(fwd) OVER (PARTITION BY date) AS target FROM (SELECT x.date, x.ticker, i, CASE WHEN EXISTS (SELECT 1 FROM membership m
    WHERE m.ticker = x.ticker AND x.date >= m.start AND (m."end" IS NULL OR x.date <= m."end")) THEN ahead / close - 1 END AS fwd FROM (
    SELECT date, ticker, close, lead(close, 20) OVER w AS ahead, row_number() OVER w AS i FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY date)) x)""")
cte("bp_rank", "SELECT date, ticker, " + ", ".join(f"{pct_sql(x)} - 0.5 AS {n}" for n, x in (("rk_mom", "mom"), ("rk_vol", "v20"), ("rk_rs", "rs"), ("rk_liq", "liq"), ("rk_q", "q"))) + " FROM bases_q")
_clean = ", ".join(f"CASE WHEN isfinite({v}) THEN {v} END AS {v}" for v in ("mom20", "mom60", "rv", "bz", "v20"))
cte("bp_raw", f"SELECT f.* REPLACE ({_clean}), k.* EXCLUDE (date, ticker) FROM fpanel f JOIN bp_rank k ON f.date = k.date AND f.ticker = k.ticker")
cte("bp_cut", "SELECT date, " + ", ".join(f"quantile_cont({v}, 0.01) AS lo_{v}, quantile_cont({v}, 0.99) AS hi_{v}" for v in _PANEL.values()) + " FROM bp_raw GROUP BY 1")
# the longest feature needs 120 rows before a name's first complete one; a flat month has no score of its band
add("build_panel", lambda s, d: full_panel(s, d, winsorize_pct=0.01)[0].select("date", "ticker", *[rc(x).alias(x) for x in _PANEL], rc("target").alias("target")),
    "SELECT p.date, p.ticker, " + ", ".join(f"{r(f'greatest(least({v}, hi_{v}), lo_{v})')} AS {k}" for k, v in _PANEL.items()) + f""", {r('target')} AS target
    FROM bp_raw p JOIN bp_cut q ON p.date = q.date JOIN bp_label l ON l.date = p.date AND l.ticker = p.ticker WHERE i > 120 AND target IS NOT NULL AND bz IS NOT NULL""")


# --- books of the daily run ----------------------------------------------------------------------------------------
def assignment(s, d):
    """Brands dealt to the five books by their number."""
    from ..functions.columns import first_match
    from ..plans.books import BOOKS
    return t.tickers(s, d).withColumn("book", first_match([(t.brand_number() % 5 == i, b.name) for i, b in enumerate(BOOKS)], None))


def book_inputs(s, d):
    """Stored bars, price level, and the dealt books."""
    bars = stored(s, t.bars_filled(s, d), "bars")
    return bars, t.price_level(bars).select("date", "close"), assignment(s, d)


def daily_books(s, d):
    """All families, sector-neutral; holdings and governor of the ledger's last state, every seventh brand a microcap."""
    from ..plans.books import build_books
    bars, bench, books = book_inputs(s, d)
    held = books.select("book", "ticker", (t.brand_number() % 4 / 100.0).alias("weight"))
    gates = books.select("book").distinct().withColumn("exposure", F.when(c("book") == "crypto", 0.5).otherwise(1.0))
    return build_books(bars, bench, books, current=held, governor=gates, sectors=t.sectors(s, d), filings=t.filings(s, d), insider=t.insider_tx(s, d),
                       microcaps=t.tickers(s, d).where(t.brand_number() % 7 == 0))


def given_decisions(s, d):
    """Decisions of every month's last trading day from given scores (20-day log momentum)."""
    bars, bench, books = book_inputs(s, d)
    last = bars.groupBy(F.date_trunc("month", "date").alias("_m")).agg(F.max("date").alias("date")).select("date")
    scores = stored(s, t.filing_scores(s, d).select("date", "ticker", "score").where("score IS NOT NULL").join(F.broadcast(last), "date").join(books, "ticker"), "scores")
    held = books.select("book", "ticker", (t.brand_number() % 4 / 100.0).alias("weight"))
    gates = books.select("book").distinct().withColumn("exposure", F.when(c("book") == "crypto", 0.5).otherwise(1.0))
    return scores, bars, bench, books, dict(current=held, governor=gates, microcaps=t.tickers(s, d).where(t.brand_number() % 7 == 0), crowded=0.02)


def decide_given(scores, bars, bench, books, **options):
    from ..plans.books import decide_books
    return decide_books(scores, bars, bench, books, **options)


def given_overload(s, d):
    from ..plans.books import BOOKS, basket_overload, by_book
    scores, bars, _, books, _ = given_decisions(s, d)
    return basket_overload(scores, bars, books, by_book(BOOKS, lambda b: b.top_quantile, c("book")), 0.02)


def system(s, d):
    """The combined system with its caps and the learning multipliers of the ledger's sleeves."""
    from ..operators import monitor as mon, portfolio as pf
    from ..plans.books import combine_system
    mult = pf.learning_multipliers(mon.rolling_performance(t.ledger(s, d))).withColumn(
        "sleeve", F.when(c("sleeve") == "sleeve_0", "stocks").when(c("sleeve") == "sleeve_1", "crypto").when(c("sleeve") == "sleeve_2", "metals").otherwise(c("sleeve")))
    held = daily_books(s, d).withColumn("weight", F.greatest("weight", F.lit(0.04)))
    return combine_system(held, {"stocks": 0.65, "metals": 0.15, "crypto": 0.20}, mult)


def _book_rows():
    from ..plans.books import BOOKS
    return ", ".join(f"({i}, '{b.name}', {min(b.class_cap, 0.05) if b.bucket == 'experimental' else b.class_cap}, {b.position_cap}, {b.top_quantile}, {b.kelly})" for i, b in enumerate(BOOKS))


cte("bk", f"SELECT * FROM (VALUES {_book_rows()}) v(id, book, cap, pos_cap, q, kf)")
cte("bk_names", "SELECT ticker, num, book, cap, pos_cap, q, kf FROM names JOIN bk ON num % 5 = id")
cte("bk_days", "SELECT max(date) AS date FROM cal GROUP BY date_trunc('month', date)")
cte("bk_scores", "SELECT s.date, s.ticker, s.score, n.* EXCLUDE (ticker) FROM scored s JOIN bk_names n ON s.ticker = n.ticker WHERE s.score IS NOT NULL AND s.date IN (SELECT date FROM bk_days)")
cte("bk_rets", "SELECT book, r.strategy AS ticker, r.date, r.ret FROM rets r JOIN bk_names n ON r.strategy = n.ticker")
cte("bk_whole", """SELECT book, date, row_number() OVER (PARTITION BY book ORDER BY date) AS k FROM (
    SELECT r.book, r.date FROM bk_rets r JOIN (SELECT book, count(*) AS n FROM bk_names GROUP BY 1) m ON r.book = m.book GROUP BY r.book, r.date, m.n HAVING count(*) = m.n)""")
cte("bk_rank", "SELECT *, row_number() OVER (PARTITION BY book, date ORDER BY score DESC, ticker) <= greatest(ceil(count(*) OVER (PARTITION BY book, date) * q), 1) AS long FROM bk_scores")
cte("bk_at", "SELECT x.book, x.date, max(k) AS k FROM (SELECT DISTINCT book, date FROM bk_scores) x JOIN bk_whole w ON w.book = x.book AND w.date <= x.date GROUP BY 1, 2")
cte("bk_basket", """SELECT p.book, p.date AS day, p.ticker, r.date, r.ret FROM bk_rank p JOIN bk_at a ON p.book = a.book AND p.date = a.date
    JOIN bk_whole w ON w.book = p.book AND w.k > a.k - 60 AND w.k <= a.k JOIN bk_rets r ON r.ticker = p.ticker AND r.date = w.date WHERE p.long""")
cte("bk_pairs", "SELECT a.book, a.day, corr(a.ret, b.ret) AS k FROM bk_basket a JOIN bk_basket b ON a.book = b.book AND a.day = b.day AND a.date = b.date AND a.ticker < b.ticker GROUP BY a.book, a.day, a.ticker, b.ticker")
cte("bk_over", "SELECT book, day AS date, avg(k) AS avg_corr, avg(k) > 0.02 AS overload FROM bk_pairs GROUP BY 1, 2")
cte("bk_exposure", """SELECT g.date, CASE regime WHEN 'bull' THEN 1 WHEN 'recovery' THEN 0.7 WHEN 'chop' THEN 0.5 WHEN 'high_vol' THEN 0.3 WHEN 'bear' THEN 0.2 ELSE 0 END::DOUBLE AS e, m, v, n
    FROM regime6 g JOIN (SELECT date, avg(r1) OVER w AS m, var_samp(r1) OVER w AS v, count(r1) OVER w AS n FROM rg_a WINDOW w AS (PARTITION BY 1 ORDER BY date ROWS 59 PRECEDING)) x ON g.date = x.date""")
def book_ctes(stem: str, crowded: float, crypto_gate: float) -> None:
    """Decisions and capped weights from ``bk_rank``, step by step: ``<stem>_a`` to ``<stem>_f``."""
    cte(f"{stem}_a", f"""SELECT r.*, ({pct_sql('score', 'r.book, r.date').replace('BY score', 'BY r.score')}) * 100 AS p, e > 0 AS on_, coalesce(o.avg_corr > {crowded}, false) AS ov, (num % 4) / 100.0::DOUBLE AS cur,
        e * (0.5 + 0.5 * CASE WHEN n < 5 OR v IS NULL OR v <= 0 THEN 1 ELSE least(greatest(kf * m / v, 0), 1) END) * CASE WHEN r.book = 'crypto' THEN {crypto_gate} ELSE 1 END AS gv
        FROM bk_rank r JOIN bk_exposure x ON r.date = x.date LEFT JOIN bk_over o ON r.book = o.book AND r.date = o.date""")
    cte(f"{stem}_b", f"SELECT *, CASE WHEN NOT long OR p < 40 THEN 0 WHEN p < 60 THEN 0.3 WHEN p < 80 THEN 0.7 ELSE 1 END::DOUBLE AS raw, score - 0.001 AS ev FROM {stem}_a")
    cte(f"{stem}_c", f"""SELECT *, greatest(least(coalesce(raw / nullif(sum(raw) OVER (PARTITION BY book, date), 0), 0) * gv * CASE WHEN on_ THEN 1 ELSE 0 END * CASE WHEN ov THEN 0.5 ELSE 1 END, pos_cap), 0) AS tgt FROM {stem}_b""")
    cte(f"{stem}_d", f"""SELECT *, round(tgt, 4) * CASE WHEN sum(round(tgt, 4)) OVER (PARTITION BY book, date) > cap THEN cap / sum(round(tgt, 4)) OVER (PARTITION BY book, date) ELSE 1 END AS w1 FROM {stem}_c""")
    cte(f"{stem}_e", f"SELECT *, CASE WHEN num % 7 = 0 THEN least(w1, 0.01) ELSE w1 END AS w2 FROM {stem}_d")
    cte(f"{stem}_f", f"SELECT *, sum(CASE WHEN num % 7 = 0 THEN w2 ELSE 0 END) OVER (PARTITION BY book, date) AS micro FROM {stem}_e")


book_ctes("bk", 0.02, 0.5)
add("basket_overload", lambda s, d: given_overload(s, d).select("book", "date", rc("avg_corr").alias("avg_corr"), "overload"),
    f"SELECT a.book, a.date, {r('avg_corr')} AS avg_corr, coalesce(overload, false) AS overload FROM bk_at a LEFT JOIN bk_over o ON a.book = o.book AND a.date = o.date")
add("book_decisions", lambda s, d: (lambda g: decide_given(*g[:4], **g[4]))(given_decisions(s, d)).select(
        "book", "date", "ticker", "action", "ev_score", "confidence", "target_weight", "reasoning", rc("weight").alias("weight")),
    f"""SELECT book, date, ticker, CASE WHEN gv <= 0 THEN CASE WHEN cur > 0 THEN 'SELL' ELSE 'NO TRADE' END WHEN NOT on_ THEN CASE WHEN cur > tgt THEN 'REDUCE' WHEN tgt = 0 THEN 'NO TRADE' ELSE 'HOLD' END
        WHEN ev <= 0 OR (p < 60 AND tgt = 0) THEN CASE WHEN cur > 0 THEN 'SELL' ELSE 'NO TRADE' END WHEN tgt > cur + 1e-6 THEN 'BUY' WHEN tgt < cur - 1e-6 THEN 'REDUCE' ELSE 'HOLD' END AS action,
        round(ev, 5) + 0.0::DOUBLE AS ev_score, round(p, 1) AS confidence, round(tgt, 4) AS target_weight,
        CASE WHEN gv <= 0 THEN 'governor' WHEN NOT on_ THEN 'regime' WHEN ev <= 0 THEN 'no_edge' WHEN p < 60 AND tgt = 0 THEN 'low_confidence' WHEN tgt > cur + 1e-6 THEN 'scale_up' WHEN tgt < cur - 1e-6 THEN 'trim' ELSE 'at_target' END AS reasoning,
        {r('CASE WHEN num % 7 = 0 AND micro > 0.1 THEN w2 * 0.1 / micro ELSE w2 END')} AS weight FROM bk_f""")
add("build_books", daily_books)


def daily(s, d):
    """The run of the last month end, on a ledger that holds the books' and the market's rows of the month end before."""
    from ..plans.daily import MARKET, daily_run
    scores, bars, bench, books, options = given_decisions(s, d)
    days = [r.date for r in scores.select("date").distinct().orderBy(c("date").desc()).limit(2).collect()]
    rows = options["current"].select(c("book").alias("sleeve"), c("ticker").alias("asset"), c("weight").alias("target_weight")).unionByName(
        s.createDataFrame([(MARKET, MARKET, 1.0)], "sleeve string, asset string, target_weight double"))
    entry = F.struct("asset", F.lit("BUY").alias("action"), F.lit(0.0).alias("ev_score"), F.lit("LOW").alias("risk_status"), F.lit(50.0).alias("confidence"), "target_weight",
                     F.lit("").alias("reasoning"), F.lit("").alias("sources"))
    ledger = rows.groupBy("sleeve").agg(F.collect_list(entry).alias("decisions")).select(F.lit(days[1]).alias("date"), "sleeve", F.lit(None).cast("double").alias("day_return"), "decisions")
    return daily_run(ledger, bars, bench, books, scores=scores.where(c("date") == days[0]), microcaps=options["microcaps"])[1]


book_ctes("dr", 0.8, 1.0)
cte("dr_days", "SELECT max(date) AS d1, (SELECT max(date) FROM bk_days WHERE date < (SELECT max(date) FROM bk_days)) AS d0 FROM bk_days")
cte("dr_sys", """SELECT sum(w) AS exposure, count(*) AS n FROM (SELECT ticker, sum(weight * least(1, cap2 / total)) AS w FROM (SELECT *, sum(weight) OVER (PARTITION BY book) AS total, CASE book WHEN 'stocks' THEN 0.65 WHEN 'metals' THEN 0.15 ELSE 0.2 END AS cap2
    FROM (SELECT book, ticker, CASE WHEN num % 7 = 0 AND micro > 0.1 THEN w2 * 0.1 / micro ELSE w2 END AS weight FROM dr_f WHERE date = (SELECT d1 FROM dr_days) AND book IN ('stocks', 'metals', 'crypto')) WHERE weight > 0) GROUP BY 1)""")
add("daily_run", lambda s, d: daily(s, d).select("sleeve", "date", c("n_positions").cast("long").alias("n_positions"), rc("exposure").alias("exposure"), rc("day_return").alias("day_return"), "logged", "n_days", "governor"),
    f"""SELECT book AS sleeve, d1 AS date, n AS n_positions, {r('exposure')} AS exposure, {r('ret')} AS day_return, true AS logged, (ret IS NOT NULL)::BIGINT AS n_days, 'ok' AS governor FROM (
        SELECT f.book, count(*) FILTER (WHERE weight > 0) AS n, sum(weight) AS exposure, any_value(g.ret) AS ret FROM (
            SELECT book, CASE WHEN num % 7 = 0 AND micro > 0.1 THEN w2 * 0.1 / micro ELSE w2 END AS weight FROM dr_f WHERE date = (SELECT d1 FROM dr_days)) f
        JOIN (SELECT book, sum((num % 4) / 100.0::DOUBLE * (b.close / a.close - 1)) AS ret FROM bk_names n, dr_days JOIN filled a ON a.date = d0 JOIN filled b ON b.date = d1 AND b.ticker = a.ticker WHERE n.ticker = a.ticker GROUP BY 1) g ON f.book = g.book GROUP BY 1
        UNION ALL SELECT 'full_system', n, exposure, NULL FROM dr_sys
        UNION ALL SELECT 'market', 1, 1.0::DOUBLE, b.close / a.close - 1 FROM dr_days JOIN bench a ON a.date = d0 JOIN bench b ON b.date = d1), dr_days""")
add("combine_system", system)
