"""Queries over weights, costs, returns, governance, decisions, ledger statistics and resampling."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import columns as col
from ..functions.windows import ordered
from ..operators import cross_section as xs
from ..operators import decisions as dec
from ..operators import evaluate as ev
from ..operators import governance as gov
from ..operators import joins, monitor as mon, portfolio as pf, relative, resample
from ..operators import regime as rg
from ..session import stored
from ..sources import ledger as led
from ..sources import tables as t
from .base import add, cte, r, rc
from .evaluation import _bench, _rets
from .features import W
from .relational import _score_assets, pct_sql, scratch

c = F.col
EVERY, CAP = 20, 0.2


def rebal(s, d):
    return pf.every_nth(t.trading_calendar(s, d), EVERY)


def picks(s, d):
    """Two strategies, top 30% and top 10% by score, on rebalance dates."""
    scores = t.filing_scores(s, d).join(F.broadcast(rebal(s, d)), "date").select("date", "pos", "rebal_no", "ticker", "score")
    both = [xs.top_quantile(scores, q).withColumn("strategy", F.lit(n)) for n, q in (("top30", 0.3), ("top10", 0.1))]
    return both[0].unionByName(both[1]).select("strategy", "rebal_no", "date", "pos", "ticker", "pick")


def returns_r(s, d):
    return pf.daily_returns(t.bars_filled(s, d)).withColumn("r", c("r") / 100)


def weights(s, d):
    return pf.equal_weight(picks(s, d), CAP).select("strategy", "rebal_no", "date", "pos", "ticker", "weight")


def cap_ctes(stem: str, src: str, cap: float, by: str = "strategy, date") -> str:
    over = f"OVER (PARTITION BY {by})"
    cte(f"{stem}_0", f"SELECT *, greatest(weight, 0) / sum(greatest(weight, 0)) {over} AS w FROM {src}")
    for i in range(10):
        cte(f"{stem}_{i + 1}", f"""SELECT * EXCLUDE (ex, un) REPLACE (CASE WHEN w > {cap} THEN {cap}::DOUBLE ELSE w + coalesce(ex * w / nullif(un, 0), 0) END AS w) FROM (
            SELECT *, sum(CASE WHEN w > {cap} THEN w - {cap} ELSE 0 END) {over} AS ex, sum(CASE WHEN w > {cap} THEN 0 ELSE w END) {over} AS un FROM {stem}_{i})""")
    cte(stem, f"SELECT * REPLACE (w / sum(w) {over} AS w) FROM {stem}_10")
    return stem


cte("rebal", f"SELECT date, pos, pos // {EVERY} AS rebal_no FROM cal WHERE pos % {EVERY} = 0")
cte("picks", """SELECT 'top30' AS strategy, b.rebal_no, p.date, p.pos, ticker, rn AS pick FROM picked p JOIN rebal b ON p.date = b.date WHERE rn <= greatest(ceil(n * 0.3), 1)
    UNION ALL SELECT 'top10', b.rebal_no, p.date, p.pos, ticker, rn FROM picked p JOIN rebal b ON p.date = b.date WHERE rn <= greatest(ceil(n * 0.1), 1)""")
cte("rr", f"SELECT date, pos, ticker, (close / lag(close) OVER ({W}) - 1) / 100 AS r FROM filled")
cte("w_eq_in", "SELECT *, 1.0::DOUBLE AS weight FROM picks")
cap_ctes("w_eq", "w_eq_in", CAP)
add("every_nth", rebal, "SELECT date, rebal_no FROM rebal")
add("equal_weight", lambda s, d: weights(s, d).select("strategy", "date", "ticker", rc("weight").alias("weight")), f"SELECT strategy, date, ticker, {r('w')} AS weight FROM w_eq")


def _raw_weights(s, d):
    """Unequal weights: picks weighted by inverse rank squared."""
    return picks(s, d).withColumn("weight", 1.0 / (c("pick") * c("pick")))


cte("w_raw", "SELECT *, 1.0::DOUBLE / (pick * pick) AS weight FROM picks")
cap_ctes("w_cap", "w_raw", CAP)
cap_ctes("w_strict", "w_raw", 0.1)
add("cap_and_normalize", lambda s, d: pf.cap_and_normalize(_raw_weights(s, d), CAP).select("strategy", "date", "ticker", rc("weight").alias("weight")), f"SELECT strategy, date, ticker, {r('w')} AS weight FROM w_cap")
add("cap_strict",
    lambda s, d: pf.cap_and_normalize(_raw_weights(s, d), 0.1, strict=True).groupBy("strategy", "date").agg(rc(F.sum("weight")).alias("invested"), rc(F.max("weight")).alias("largest")),
    f"SELECT strategy, date, {r('sum(least(w, 0.1))')} AS invested, {r('max(least(w, 0.1))')} AS largest FROM w_strict_10 GROUP BY 1, 2")
cte("look", "SELECT p.strategy, p.date, p.ticker, x.pos, x.r FROM picks p JOIN rr x ON p.ticker = x.ticker AND x.pos BETWEEN p.pos - 59 AND p.pos WHERE r IS NOT NULL")
cte("look_full", "SELECT strategy, date, pos FROM look l GROUP BY 1, 2, 3 HAVING count(*) = (SELECT count(DISTINCT ticker) FROM look z WHERE z.strategy = l.strategy AND z.date = l.date)")
cte("ivol_a", "SELECT strategy, date, ticker, 1 / nullif(stddev_samp(r), 0) AS iv FROM look JOIN look_full USING (strategy, date, pos) GROUP BY 1, 2, 3")
cte("ivol_b", "SELECT strategy, date, ticker, coalesce(iv, avg(iv) OVER (PARTITION BY strategy, date)) AS weight FROM ivol_a")
cap_ctes("w_iv", "ivol_b", CAP)
add("inverse_vol", lambda s, d: pf.inverse_vol(picks(s, d), returns_r(s, d), CAP).select("strategy", "date", "ticker", rc("weight").alias("weight")), f"SELECT strategy, date, ticker, {r('w')} AS weight FROM w_iv")
add("risk_parity", lambda s, d: pf.risk_parity(picks(s, d), returns_r(s, d), CAP).select("strategy", "date", "ticker", rc("weight").alias("weight")))


def risk_parity_balance(s, d):
    """Per book: do all names carry the same risk, ``w_i cov(r_i, portfolio)``, before any cap, and do they sum to 1?"""
    chosen, returns = stored(s, picks(s, d), "picks"), stored(s, returns_r(s, d), "returns")
    w = stored(s, pf.risk_parity(chosen, returns, 1.0), "parity")
    hist = pf.lookback_returns(chosen, returns).join(w, ["strategy", "date", "ticker"])
    both = hist.withColumn("_p", F.sum(c("weight") * c("r")).over(Window.partitionBy("strategy", "date", "pos")))
    risk = both.groupBy("strategy", "date", "ticker").agg((F.first("weight") * F.covar_samp("r", "_p")).alias("risk"), F.first("weight").alias("weight"))
    return risk.groupBy("strategy", "date").agg(F.count(F.lit(1)).alias("n_names"), (F.max("risk") / F.min("risk") - 1 < 1e-6).alias("balanced"), rc(F.sum("weight"), 9).alias("total"))


add("risk_parity_balance", risk_parity_balance, "SELECT strategy, date, count(*) AS n_names, true AS balanced, 1.0::DOUBLE AS total FROM picks GROUP BY 1, 2")
cte("w_last", "SELECT strategy, max(rebal_no) AS last_no FROM w_eq GROUP BY 1")
cte("w_prev", "SELECT e.strategy, rebal_no + 1 AS rebal_no, ticker, w FROM w_eq e JOIN w_last l ON e.strategy = l.strategy WHERE rebal_no < last_no")
cte("w_delta", """SELECT coalesce(a.strategy, b.strategy) AS strategy, coalesce(a.rebal_no, b.rebal_no) AS rebal_no, coalesce(a.ticker, b.ticker) AS ticker, coalesce(b.w, 0) AS old_w, coalesce(a.w, 0) AS new_w
    FROM w_eq a FULL JOIN w_prev b ON a.strategy = b.strategy AND a.rebal_no = b.rebal_no AND a.ticker = b.ticker""")
add("weight_delta_join", lambda s, d: joins.weight_delta_join(weights(s, d)).select("strategy", "rebal_no", "ticker", rc("old_w").alias("old_w"), rc("new_w").alias("new_w")),
    f"SELECT strategy, rebal_no, ticker, {r('old_w')} AS old_w, {r('new_w')} AS new_w FROM w_delta", dates="")
cte("turn", "SELECT strategy, rebal_no, sum(abs(new_w - old_w)) AS turnover FROM w_delta GROUP BY 1, 2")
add("turnover", lambda s, d: pf.turnover(weights(s, d)).select("strategy", "rebal_no", rc("turnover").alias("turnover")), f"SELECT strategy, rebal_no, {r('turnover')} AS turnover FROM turn", dates="")
add("average_turnover", lambda s, d: pf.average_turnover(weights(s, d)).select("strategy", rc("avg_turnover").alias("avg_turnover"), "n_rebalances"),
    f"SELECT strategy, {r('avg(turnover)')} AS avg_turnover, count(*) AS n_rebalances FROM turn GROUP BY 1", dates="")
add("turnover_cost", lambda s, d: pf.turnover(weights(s, d)).select("strategy", "rebal_no", rc(col.turnover_cost("turnover", 1.0, 4.0), 9).alias("cost")), f"SELECT strategy, rebal_no, {r('turnover * 5 / 1e4', 9)} AS cost FROM turn", dates="")
cte("held", """SELECT k.strategy, x.date, x.pos, sum(w * coalesce(x.r, 0)) AS gross FROM w_eq k JOIN (
    SELECT strategy, rebal_no, coalesce(lead(pos) OVER (PARTITION BY strategy ORDER BY rebal_no), (SELECT max(pos) FROM cal)) AS upto FROM (SELECT DISTINCT strategy, rebal_no, pos FROM w_eq)) b
    ON k.strategy = b.strategy AND k.rebal_no = b.rebal_no JOIN rr x ON x.ticker = k.ticker AND x.pos > k.pos AND x.pos <= b.upto GROUP BY 1, 2, 3""")
cte("pret", """SELECT coalesce(h.strategy, u.strategy) AS strategy, coalesce(h.date, u.date) AS date, coalesce(gross, 0) AS gross, coalesce(turnover, 0) * 5 / 1e4 AS cost, coalesce(gross, 0) - coalesce(turnover, 0) * 5 / 1e4 AS ret
    FROM held h FULL JOIN (SELECT t.strategy, b.date, turnover FROM turn t JOIN rebal b ON t.rebal_no = b.rebal_no) u ON h.strategy = u.strategy AND h.date = u.date""")


def port_returns(s, d):
    # weights carry ten rounds of capping and are read four times
    return pf.portfolio_returns(stored(s, weights(s, d), "weights"), returns_r(s, d), stored(s, t.trading_calendar(s, d), "calendar"))


add("portfolio_returns", lambda s, d: port_returns(s, d).select("strategy", "date", rc("gross", 8).alias("gross"), rc("cost", 8).alias("cost"), rc("ret", 8).alias("ret")),
    f"SELECT strategy, date, {r('gross', 8)} AS gross, {r('cost', 8)} AS cost, {r('ret', 8)} AS ret FROM pret")


def ls_weights(s, d):
    scores = t.filing_scores(s, d).join(F.broadcast(rebal(s, d)), "date")
    return xs.long_short_legs(scores, 0.3).select(F.lit("ls").alias("strategy"), "rebal_no", "date", "pos", "ticker", "weight")


cte("w_ls", """SELECT 'ls' AS strategy, b.rebal_no, p.date, p.pos, ticker, CASE WHEN rn <= k THEN 0.5 / k ELSE 0 END - CASE WHEN rb <= k THEN 0.5 / k ELSE 0 END AS w
    FROM (SELECT *, greatest(ceil(n * 0.3), 1)::DOUBLE AS k FROM picked) p JOIN rebal b ON p.date = b.date WHERE n >= 4 AND (rn <= k OR rb <= k)""")
add("long_short_returns",
    lambda s, d: pf.portfolio_returns(ls_weights(s, d), returns_r(s, d), t.trading_calendar(s, d)).where("gross <> 0").select("strategy", "date", rc("gross", 8).alias("gross")),
    f"""SELECT k.strategy, x.date, {r('sum(w * coalesce(x.r, 0))', 8)} AS gross FROM w_ls k JOIN rr x ON x.ticker = k.ticker AND x.pos > k.pos AND x.pos <= k.pos + {EVERY} GROUP BY 1, 2 HAVING sum(w * coalesce(x.r, 0)) <> 0""")
add("buy_and_hold", lambda s, d: pf.buy_and_hold(t.bars_filled(s, d), ["Brand#1", "Brand#2", "Brand#3"]).select("strategy", "date", rc("ret").alias("ret"), rc("nav").alias("nav")),
    f"""SELECT ticker AS strategy, date, {r(f'coalesce(close / lag(close) OVER ({W}) - 1, 0)')} AS ret, {r(f'close / first_value(close) OVER ({W})')} AS nav
        FROM filled WHERE ticker IN ('Brand#1', 'Brand#2', 'Brand#3')""")


def dca_input(s, d):
    bench = t.returns(s, d, 1000.0).where("strategy = 'Brand#1'").select("date", c("ret").alias("ret_spy"))
    return t.returns(s, d, 1000.0).join(bench, "date")


cte("dca_in", """SELECT a.strategy, a.date, a.ret / 1000 AS ret, b.ret / 1000 AS sret FROM rets a JOIN (SELECT date, ret FROM rets WHERE strategy = 'Brand#1') b ON a.date = b.date""")
cte("dca_nav", """SELECT *, row_number() OVER w - 1 AS i, exp(sum(ln(1 + ret)) OVER w) AS nav, exp(sum(ln(1 + sret)) OVER w) AS snav,
    exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date ROWS 19 PRECEDING)) - 1 AS recent FROM dca_in WINDOW w AS (PARTITION BY strategy ORDER BY date)""")
_PAY = {"none": "0.0::DOUBLE", "dca": "CASE WHEN i > 0 AND i % 10 = 0 THEN 0.1 ELSE 0 END::DOUBLE",
        "variable": "CASE WHEN i > 0 AND i % 10 = 0 THEN 0.1 * greatest(least(1 - 5 * recent, 2), 0.5) ELSE 0 END::DOUBLE"}
for _mode, _pay in _PAY.items():
    cte(f"dca_{_mode}", f"SELECT *, {_pay} AS contribution FROM dca_nav")
    add(f"dca_schedule_{_mode}",
        (lambda m: lambda s, d: pf.dca_schedule(dca_input(s, d), m).select(
            "strategy", "date", rc("contribution").alias("contribution"), rc("equity").alias("equity"), rc("equity_spy").alias("equity_spy")))(_mode),
        f"""SELECT strategy, date, {r('contribution')} AS contribution, {r('nav * (1 + sum(contribution / nav) OVER (PARTITION BY strategy ORDER BY date))')} AS equity,
            {r('snav * (1 + sum(contribution / snav) OVER (PARTITION BY strategy ORDER BY date))')} AS equity_spy FROM dca_{_mode}""")

# --- sizing -----------------------------------------------------------------------------------------------------------


def _rw(n: int):
    return ordered(["strategy"]).rowsBetween(-(n - 1), 0)


def _sizing(s, d):
    x = _rets(s, d)
    return x.select("strategy", "date", F.count("ret").over(_rw(60)).alias("n"), F.stddev_samp("ret").over(_rw(20)).alias("sd"), F.avg("ret").over(_rw(60)).alias("m"), F.var_samp("ret").over(_rw(60)).alias("v"))


_S = "PARTITION BY strategy ORDER BY date"
cte("sizing", f"""SELECT strategy, date, count(ret) OVER ({_S} ROWS 59 PRECEDING) AS n, stddev_samp(ret) OVER ({_S} ROWS 19 PRECEDING) * sqrt(252) AS vol,
    avg(ret) OVER ({_S} ROWS 59 PRECEDING) AS m, var_samp(ret) OVER ({_S} ROWS 59 PRECEDING) AS v FROM rets_s""")
add("vol_target", lambda s, d: _sizing(s, d).select("strategy", "date", rc(col.vol_target_scalar(c("sd") * (252 ** 0.5), "n", 0.15)).alias("scalar")),
    f"SELECT strategy, date, {r('CASE WHEN n < 5 OR vol IS NULL OR vol = 0 THEN 1 ELSE least(0.15 / vol, 1) END')} AS scalar FROM sizing")
add("kelly", lambda s, d: _sizing(s, d).select("strategy", "date", rc(col.kelly_fraction("m", "v", 0.5)).alias("fraction"), rc(col.kelly_exposure("m", "v", "n", 0.25)).alias("exposure")),
    f"""SELECT strategy, date, {r('coalesce(greatest(least(m / nullif(v, 0), 0.5), 0) * CASE WHEN v > 0 THEN 1 END, 0)')} AS fraction,
        {r('CASE WHEN n < 5 OR v IS NULL OR v <= 0 THEN 1 ELSE greatest(least(0.25 * m / v, 1), 0) END')} AS exposure FROM sizing""")


def _cash(s, d):
    w = rg._spec(())
    b = _bench(s, d).withColumn("_r", (col.safe_div(c("close"), F.lag("close").over(w)) - 1) / 10)
    b = b.select("date", (F.stddev_samp("_r").over(w.rowsBetween(-19, 0)) * (252 ** 0.5)).alias("vol"))
    return relative.breadth(t.bars_filled(s, d), (200,)).join(b, "date").where("vol IS NOT NULL").select("date", rc(col.cash_regime_scalar("breadth_pct_above_200", "vol")).alias("scalar"))


add("cash_regime", _cash,
    f"""SELECT b.date, {r('0.5 * greatest(least(breadth_pct_above_200 / 0.5, 1), 0) + 0.5 * greatest(least(0.3 / greatest(vol, 1e-6), 1), 0)')} AS scalar FROM breadth b JOIN (
        SELECT date, stddev_samp(r1 / 10) OVER (PARTITION BY 1 ORDER BY date ROWS 19 PRECEDING) * sqrt(252) AS vol FROM rg_a) v ON b.date = v.date WHERE vol IS NOT NULL""")

# --- governance ---------------------------------------------------------------------------------------------------------


def overlay_market(s, d):
    w = rg._spec(())
    b = _bench(s, d).withColumn("_r", (col.safe_div(c("close"), F.lag("close").over(w)) - 1) / 100)
    b = b.select("date", (F.stddev_samp("_r").over(w.rowsBetween(-19, 0)) * (252 ** 0.5)).alias("market_vol"))
    on = rg.classify_regime(_bench(s, d)).select("date", "risk_on")
    br = relative.breadth(t.bars_filled(s, d), (200,)).select("date", c("breadth_pct_above_200").alias("breadth200"))
    return b.join(on, "date").join(br, "date")


SCENARIOS = [
    gov.Scenario("plain"), gov.Scenario("vol_target", vol_target=0.12), gov.Scenario("kelly", kelly_fraction=0.25),
    gov.Scenario("regime", regime_off=0.2), gov.Scenario("cash", cash_regime=True), gov.Scenario("governed", hard_risk=True),
    gov.Scenario("all", 0.12, 0.25, 0.2, True, True),
]


def overlays(s, d):
    book = stored(s, port_returns(s, d), "book")
    return gov.apply_overlays(book, overlay_market(s, d), SCENARIOS)


def governor_ctes(stem: str, src: str) -> str:
    """States after each return, and the reason before it, from running products and places of last events."""
    w = "OVER (PARTITION BY strategy ORDER BY date)"
    cte(f"{stem}_a", f"SELECT strategy, date, ret, count(ret) {w} AS n, product(1 + ret) {w} AS nav FROM {src}")
    cte(f"{stem}_b", f"SELECT *, greatest(1, max(nav) {w}) AS peak, coalesce(max(CASE WHEN ret >= 0 THEN n END) {w}, 0) AS gain FROM {stem}_a")
    cte(f"{stem}_c", f"""SELECT *, max(CASE WHEN ret <= -0.04 OR ret < 0 AND n - gain >= 3 THEN n END) {w} AS hit,
        last_value(CASE WHEN ret IS NULL THEN NULL WHEN nav / peak - 1 <= -0.2 THEN 1 WHEN nav / peak - 1 >= -0.1 THEN 0 END IGNORE NULLS) {w} AS down FROM {stem}_b""")
    cte(f"{stem}_d", f"SELECT *, CASE WHEN ret IS NULL THEN NULL WHEN down = 1 THEN 'drawdown' WHEN n - hit < 5 THEN 'cooldown' ELSE 'ok' END AS state FROM {stem}_c")
    cte(stem, f"""SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ok') AS reason
        FROM {stem}_d""")
    return stem


cte("gvr_in", "SELECT strategy, date, ret / 10 AS ret FROM rets")
governor_ctes("gvr", "gvr_in")
governor_ctes("gvb", "pret")
cte("gvl_in", "SELECT sleeve AS strategy, date, day_return AS ret FROM ledger")
governor_ctes("gvl", "gvl_in")
cte("ov_m", """SELECT a.date, risk_on, breadth_pct_above_200 AS br, stddev_samp(r1 / 100) OVER (PARTITION BY 1 ORDER BY a.date ROWS 19 PRECEDING) * sqrt(252) AS mv
    FROM rg_a a JOIN regime2 g ON a.date = g.date JOIN breadth b ON a.date = b.date""")
_P = lambda k: f"OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
cte("ov_a", f"""SELECT p.*, CASE WHEN g.reason = 'ok' THEN 1.0::DOUBLE ELSE 0 END AS gv, risk_on, br, mv FROM pret p
    JOIN gvb g ON p.strategy = g.strategy AND p.date = g.date LEFT JOIN ov_m m ON p.date = m.date""")
_Q = "OVER (PARTITION BY strategy ORDER BY date)"
cte("ov_b", f"""SELECT *, count(ret) {_P(20)} AS n, stddev_samp(ret) {_P(20)} * sqrt(252) AS vol, avg(ret) {_P(60)} AS me, var_samp(ret) {_P(60)} AS va,
    count(ret) {_P(60)} AS m, lag(risk_on) {_Q} AS lo, lag(br) {_Q} AS lb, lag(mv) {_Q} AS lm FROM ov_a""")
cte("ov_c", """SELECT *, CASE WHEN n < 5 OR vol IS NULL OR vol = 0 THEN 1.0::DOUBLE ELSE least(0.12 / vol, 1) END AS vt,
    CASE WHEN m < 5 OR va IS NULL OR va <= 0 THEN 1.0::DOUBLE ELSE greatest(least(0.25 * me / va, 1), 0) END AS ke, CASE WHEN lo < 0.5 THEN 0.2::DOUBLE ELSE 1 END AS rg,
    CASE WHEN lb IS NULL THEN 1.0::DOUBLE ELSE 0.5 * greatest(least(lb / 0.5, 1), 0) + 0.5 * greatest(least(0.3 / greatest(coalesce(lm, 0), 1e-6), 1), 0) END AS ca FROM ov_b""")
cte("ov_d", """SELECT strategy, date, gross, cost, ret, unnest(['plain', 'vol_target', 'kelly', 'regime', 'cash', 'governed', 'all']) AS scenario,
    unnest([1.0::DOUBLE, vt, ke, rg, ca, gv, ca * vt * ke * rg * gv]) AS e FROM ov_c""")
add("apply_overlays",
    lambda s, d: overlays(s, d).select("strategy", "scenario", "date", rc("exposure").alias("exposure"), rc("ret", 8).alias("ret")),
    f"SELECT strategy, scenario, date, {r('e')} AS exposure, {r('ret * e', 8)} AS ret FROM ov_d")
add("apply_overlays_plain",
    lambda s, d: overlays(s, d).where("scenario = 'plain' AND (gross <> 0 OR cost <> 0)").select("strategy", "date", rc("gross", 8).alias("gross"), rc("cost", 8).alias("cost"), rc("ret", 8).alias("ret")),
    f"SELECT strategy, date, {r('gross', 8)} AS gross, {r('cost', 8)} AS cost, {r('ret', 8)} AS ret FROM pret WHERE gross <> 0 OR cost <> 0")
add("governor", lambda s, d: gov.governor(t.returns(s, d, 10.0)),
    "SELECT strategy, date, CASE WHEN reason = 'ok' THEN 1.0::DOUBLE ELSE 0 END AS exposure, reason FROM gvr")
add("governor_today", lambda s, d: gov.governor_today(t.ledger(s, d).select(c("sleeve").alias("strategy"), "date", c("day_return").alias("ret"))),
    """SELECT strategy, CASE WHEN state = 'ok' THEN 1.0::DOUBLE ELSE 0 END AS exposure, state AS reason FROM (
        SELECT strategy, coalesce(arg_max(state, date) FILTER (WHERE state IS NOT NULL), 'ok') AS state FROM gvl GROUP BY 1)""", dates="")
add("no_trade_band", lambda s, d: gov.no_trade_band(weights(s, d), 0.05).select("strategy", "rebal_no", "ticker", rc("weight").alias("weight")),
    f"""WITH RECURSIVE span AS (SELECT strategy, min(rebal_no) AS lo, (SELECT max(rebal_no) FROM w_eq) AS hi FROM w_eq GROUP BY 1),
        grid AS MATERIALIZED (SELECT g.strategy, g.ticker, g.k, g.lo, coalesce(w, 0) AS new FROM (SELECT DISTINCT x.strategy, ticker, lo, unnest(generate_series(lo, hi)) AS k FROM w_eq x JOIN span p ON x.strategy = p.strategy) g
            LEFT JOIN w_eq e ON e.strategy = g.strategy AND e.ticker = g.ticker AND e.rebal_no = g.k),
        path AS (SELECT strategy, ticker, k, new AS kept FROM grid WHERE k = lo
            UNION ALL SELECT p.strategy, p.ticker, g.k, CASE WHEN abs(g.new - kept) < 0.05 THEN kept ELSE g.new END FROM path p JOIN grid g ON g.strategy = p.strategy AND g.ticker = p.ticker AND g.k = p.k + 1)
        SELECT strategy, k AS rebal_no, ticker, {r('kept')} AS weight FROM path WHERE kept <> 0""", dates="")


def _deposits(s, d):
    """Orders as deposits of nine customer groups; an opportunity on days with an urgent order."""
    return t.table(s, d, "orders").groupBy(
        F.concat(F.lit("acct_"), F.pmod("o_custkey", F.lit(9))).alias("account"), F.to_date("o_orderdate").alias("date")).agg(
        F.sum("o_totalprice").alias("deposit"), (F.max((c("o_totalprice") > 290000).cast("int")) == 1).alias("ev_ok"))


add("cash_buffer", lambda s, d: gov.cash_buffer(_deposits(s, d), 5).select("account", "date", rc("released", 2).alias("released"), rc("buffer", 2).alias("buffer")),
    f"""WITH RECURSIVE dep AS MATERIALIZED (SELECT account, date, deposit, ev, row_number() OVER (PARTITION BY account ORDER BY date) AS i FROM (
            SELECT 'acct_' || (o_custkey % 9) AS account, cast(o_orderdate AS DATE) AS date, sum(o_totalprice) AS deposit, bool_or(o_totalprice > 290000) AS ev FROM orders GROUP BY 1, 2)),
        path AS (SELECT account, 0::BIGINT AS i, 0.0::DOUBLE AS buffer, 0 AS idle, 0.0::DOUBLE AS released FROM (SELECT DISTINCT account FROM dep)
            UNION ALL SELECT p.account, d.i, CASE WHEN p.buffer + d.deposit > 0 AND NOT (d.ev OR p.idle >= 5) THEN p.buffer + d.deposit ELSE 0 END,
                CASE WHEN p.buffer + d.deposit > 0 AND NOT (d.ev OR p.idle >= 5) THEN p.idle + 1 ELSE 0 END,
                CASE WHEN p.buffer + d.deposit > 0 AND (d.ev OR p.idle >= 5) THEN p.buffer + d.deposit ELSE 0 END FROM path p JOIN dep d ON d.account = p.account AND d.i = p.i + 1)
        SELECT p.account, date, {r('released', 2)} AS released, {r('buffer', 2)} AS buffer FROM path p JOIN dep d ON d.account = p.account AND d.i = p.i""")

# --- decisions -------------------------------------------------------------------------------------------------------------


def decision_input(s, d):
    on = rg.classify_regime(_bench(s, d)).select("date", (c("risk_on") > 0.5).alias("risk_on"))
    x = relative.market_join(t.filing_scores(s, d).select("date", "ticker", "score"), on)
    return x.withColumns({
        "strategy": F.lit("all"),
        "current": F.when(t.brand_number() % 5 == 0, 0.04).otherwise(0.0),
        "governor": F.when(F.month("date") == 6, 0.0).otherwise(1.0),
        "overload": F.month("date") == 9,
    })


cte("dec_a", f"SELECT s.date, s.ticker, score, g.risk_on > 0.5 AS regime_on, CASE WHEN num % 5 = 0 THEN 0.04 ELSE 0 END::DOUBLE AS cur, CASE WHEN month(s.date) = 6 THEN 0 ELSE 1 END::DOUBLE AS gv, month(s.date) = 9 AS ov FROM scored s JOIN names n ON s.ticker = n.ticker JOIN regime2 g ON s.date = g.date WHERE score IS NOT NULL")
cte("dec_b", f"SELECT *, ({pct_sql('score')}) * 100 AS p, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= greatest(ceil(count(*) OVER (PARTITION BY date) * 0.3), 1) AS long FROM dec_a")
cte("dec_c", "SELECT *, CASE WHEN NOT long THEN 0 WHEN p < 40 THEN 0 WHEN p < 60 THEN 0.3 WHEN p < 80 THEN 0.7 ELSE 1 END::DOUBLE AS raw FROM dec_b")
cte("dec_d", """SELECT *, greatest(least(coalesce(raw / nullif(sum(raw) OVER (PARTITION BY date), 0), 0) * gv * CASE WHEN regime_on THEN 1 ELSE 0 END * CASE WHEN ov THEN 0.5 ELSE 1 END, 0.08), 0) AS tgt, score - 0.001 AS ev FROM dec_c""")
cte("dec_e", """SELECT date, ticker, CASE WHEN gv <= 0 THEN CASE WHEN cur > 0 THEN 'SELL' ELSE 'NO TRADE' END WHEN NOT regime_on THEN CASE WHEN cur > tgt THEN 'REDUCE' WHEN tgt = 0 THEN 'NO TRADE' ELSE 'HOLD' END
    WHEN ev <= 0 OR (p < 60 AND tgt = 0) THEN CASE WHEN cur > 0 THEN 'SELL' ELSE 'NO TRADE' END WHEN tgt > cur + 1e-6 THEN 'BUY' WHEN tgt < cur - 1e-6 THEN 'REDUCE' ELSE 'HOLD' END AS action,
    round(ev, 5) + 0.0::DOUBLE AS ev_score, CASE WHEN gv <= 0 OR NOT regime_on THEN 'HIGH' WHEN ev <= 0 OR (p < 60 AND tgt = 0) THEN 'MEDIUM' ELSE 'LOW' END AS risk_status,
    round(p, 1) AS confidence, round(tgt, 4) AS target_weight,
    CASE WHEN gv <= 0 THEN 'governor' WHEN NOT regime_on THEN 'regime' WHEN ev <= 0 THEN 'no_edge' WHEN p < 60 AND tgt = 0 THEN 'low_confidence' WHEN tgt > cur + 1e-6 THEN 'scale_up' WHEN tgt < cur - 1e-6 THEN 'trim' ELSE 'at_target' END AS reasoning FROM dec_d""")
add("decide", lambda s, d: dec.decide(decision_input(s, d)).drop("strategy"), "SELECT * FROM dec_e")


def _top_n(s, d):
    scores = _score_assets(s, d)
    decs = dec.decide(decision_input(s, d)).drop("strategy")
    tgt = decs.select("date", "ticker", c("target_weight").alias("weight"))
    return dec.top_n(scores, decs, tgt, t.bars_filled(s, d), 5)


add("top_n", lambda s, d: _top_n(s, d).select("date", c("place").cast("long").alias("place"), "asset", "score", "action", "ev", "risk", "confidence", "position_size", "reasoning"),
    f"""SELECT date, place, ticker AS asset, score, CASE WHEN target_weight > 0 THEN 'BUY' WHEN action IN ('SELL', 'REDUCE') THEN action WHEN comp >= 70 THEN 'WATCH' ELSE coalesce(action, 'HOLD') END AS action,
        round(ev_score, 5) AS ev, coalesce(risk_status, 'n/a') AS risk, round(confidence, 0) AS confidence, round(coalesce(target_weight, 0) * 100, 2) AS position_size, coalesce(reasoning, 'scored, not selected') AS reasoning FROM (
        SELECT a.*, e.* EXCLUDE (date, ticker), round(comp, 1) AS score, row_number() OVER (PARTITION BY a.date ORDER BY round(comp, 1) DESC, a.ticker) AS place
        FROM (SELECT date, ticker, {' + '.join(f'{v} * {k}' for k, v in xs.SCORE_WEIGHTS.items())} AS comp FROM asset_scores) a LEFT JOIN dec_e e ON a.date = e.date AND a.ticker = e.ticker) WHERE place <= 5""")
add("top_signals", lambda s, d: dec.top_signals(dec.decide(decision_input(s, d)).drop("strategy")).select("date", "ticker", "ev_score"),
    "SELECT date, ticker, ev_score FROM dec_e ORDER BY ev_score DESC, ticker LIMIT 10")
add("top_risks", lambda s, d: dec.top_risks(weights(s, d).withColumn("weight", F.round(c("weight") * (1 + c("rebal_no") / 1000), 6)), by=("strategy",)).select("strategy", "date", "ticker", "weight"),
    f"""SELECT strategy, date, ticker, {r('w * (1 + rebal_no / 1000)')} AS weight FROM w_eq
        QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY {r('w * (1 + rebal_no / 1000)')} DESC, ticker, date) <= 10""")
add("target_notional", lambda s, d: pf.target_notional(weights(s, d), 100000.0).select("strategy", "date", "ticker", "notional", "target_weight"),
    "SELECT strategy, date, ticker, round(100000 * greatest(w, 0), 2) AS notional, round(w, 4) AS target_weight FROM w_eq")

# --- books ---------------------------------------------------------------------------------------------------------------------


def sleeve_targets(s, d):
    """Quarter books: each brand belongs to one of four sleeves, weight by volume share of the day."""
    x = t.bars(s, d).select("date", "ticker", F.concat(F.lit("s"), t.brand_number() % 4).alias("sleeve"), "volume")
    tot = x.groupBy("date", "sleeve").agg(F.sum("volume").alias("_v"))
    return x.join(tot, ["date", "sleeve"]).select("date", "sleeve", "ticker", (c("volume") / c("_v")).alias("weight"))


def sleeve_table(s, d):
    n = t.brand_number()
    return t.tickers(s, d).where(n <= 4).select(
        F.concat(F.lit("s"), n % 4).alias("sleeve"), n.alias("ord"), F.when(n % 2 == 0, "crypto").otherwise("stocks").alias("asset_class"),
        (n / 10.0).alias("allocation"), F.when(n == 3, "shadow").otherwise("live").alias("status"), F.when(n % 2 == 0, 0.3).otherwise(0.7).alias("max_class_weight"),
        F.when(n == 1, "experimental").otherwise("core").alias("bucket"))


cte("stgt", "SELECT date, 's' || (num % 4) AS sleeve, b.ticker, volume / sum(volume) OVER (PARTITION BY date, num % 4) AS w FROM bars b JOIN names n ON b.ticker = n.ticker")
# live: 1 (stocks, experimental), 2 and 4 (crypto); shares 1/7, 2/7, 4/7; each sleeve sums to 1
cte("sfac", """SELECT date, sleeve, CASE sleeve WHEN 's1' THEN least(1.0::DOUBLE / 7, 0.05) / (1.0::DOUBLE / 7) WHEN 's2' THEN 1.0::DOUBLE
    ELSE greatest(0.3 - CASE WHEN has2 THEN 2.0::DOUBLE / 7 ELSE 0 END, 0) / (4.0::DOUBLE / 7) END AS f, CASE sleeve WHEN 's1' THEN 1 WHEN 's2' THEN 2 ELSE 4 END / 7.0::DOUBLE AS sh
    FROM (SELECT DISTINCT date, sleeve, bool_or(sleeve = 's2') OVER (PARTITION BY date) AS has2 FROM stgt) WHERE sleeve <> 's3'""")
add("combine_sleeves", lambda s, d: pf.combine_sleeves(sleeve_targets(s, d), sleeve_table(s, d)).select("date", "ticker", rc("weight", 9).alias("weight")),
    f"SELECT x.date, ticker, {r('w * sh * f', 9)} AS weight FROM stgt x JOIN sfac f ON x.date = f.date AND x.sleeve = f.sleeve")
add("microcap_caps",
    lambda s, d: pf.microcap_caps(weights(s, d), t.brand_number() % 3 == 0, 0.02, 0.015).select("strategy", "date", "ticker", rc("weight").alias("weight")),
    f"""SELECT strategy, date, ticker, {r('CASE WHEN m AND agg > 0.02 THEN w2 * 0.02 / agg ELSE w2 END')} AS weight FROM (SELECT *, sum(CASE WHEN m THEN w2 ELSE 0 END) OVER (PARTITION BY strategy, date) AS agg FROM (
        SELECT strategy, date, e.ticker, num % 3 = 0 AS m, CASE WHEN num % 3 = 0 THEN least(w, 0.015) ELSE w END AS w2 FROM w_eq e JOIN names n ON e.ticker = n.ticker))""")
add("is_microcap",
    lambda s, d: t.bars(s, d).select("date", "ticker", col.is_microcap("ticker", F.when(c("volume") > 10, c("close") * c("volume") * 1000), ["Brand#5"]).alias("microcap")),
    "SELECT date, ticker, ticker = 'Brand#5' OR coalesce(CASE WHEN volume > 10 THEN close * volume * 1000 END < 2e9, false) AS microcap FROM bars")
add("rescale_book", lambda s, d: pf.rescale_book(weights(s, d), F.when(c("strategy") == "top10", 0.65).otherwise(1.5)).select("strategy", "date", "ticker", rc("weight").alias("weight")),
    f"SELECT strategy, date, ticker, {r('''CASE WHEN strategy = 'top10' THEN w * 0.65 ELSE w END''')} AS weight FROM w_eq")
add("sleeve_totals",
    lambda s, d: pf.sleeve_totals(weights(s, d).withColumn("weight", c("weight") * 0.9), F.when(t.brand_number() % 3 == 0, "crypto").when(t.brand_number() % 3 == 1, "metals").otherwise("stocks")).select(
        "strategy", "date", *[rc(x).alias(x) for x in ("stocks", "crypto", "metals", "cash")]),
    f"""SELECT strategy, date, {r('sum(CASE WHEN num % 3 = 2 THEN 0.9 * w ELSE 0 END)')} AS stocks, {r('sum(CASE WHEN num % 3 = 0 THEN 0.9 * w ELSE 0 END)')} AS crypto,
        {r('sum(CASE WHEN num % 3 = 1 THEN 0.9 * w ELSE 0 END)')} AS metals, {r('greatest(1 - sum(0.9 * w), 0)')} AS cash FROM w_eq e JOIN names n ON e.ticker = n.ticker GROUP BY 1, 2""")

# --- ledger statistics ----------------------------------------------------------------------------------------------------------
cte("stand", """SELECT sleeve, count(day_return) AS n_days, exp(sum(ln(1 + day_return))) - 1 AS cum_return, avg(day_return) / nullif(stddev_samp(day_return), 0) * sqrt(252) AS sharpe, max(day_return) AS best_day,
    min(day_return) AS worst_day, avg((day_return > 0)::INT) AS win_rate, max(date) AS last_date, arg_max(n_positions, date) AS last_positions FROM ledger GROUP BY 1""")
_ST = ["cum_return", "sharpe", "best_day", "worst_day", "win_rate", "last_exposure"]
add("standings", lambda s, d: mon.standings(t.ledger(s, d)).select("sleeve", "n_days", *[rc(x, 8).alias(x) for x in _ST], "last_date", "last_positions"),
    f"SELECT sleeve, n_days, {', '.join(f'{r(x, 8)} AS {x}' for x in _ST[:-1])}, {r('0.5', 8)} AS last_exposure, last_date, last_positions FROM stand", dates="last_date")
for _f in ("week", "month"):
    add(f"period_rollup_{_f}", (lambda f: lambda s, d: mon.period_rollup(t.ledger(s, d), f).select("period", "sleeve", rc("ret", 8).alias("ret")))(_f),
        f"SELECT cast(date_trunc('{_f}', date) AS DATE) AS period, sleeve, {r('exp(sum(ln(1 + day_return))) - 1', 8)} AS ret FROM ledger GROUP BY 1, 2", dates="period")
cte("last20", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY date DESC) AS k FROM ledger) WHERE k <= 20")
add("rolling_performance", lambda s, d: mon.rolling_performance(t.ledger(s, d), 20).select("sleeve", "n_days", *[rc(x, 8).alias(x) for x in ("cum_return", "sharpe", "max_day_loss", "win_rate")]),
    f"SELECT sleeve, count(*) AS n_days, {r('exp(sum(ln(1 + day_return))) - 1', 8)} AS cum_return, {r('avg(day_return) / stddev_samp(day_return) * sqrt(252)', 8)} AS sharpe, {r('min(day_return)', 8)} AS max_day_loss, {r('avg((day_return > 0)::INT)', 8)} AS win_rate FROM last20 GROUP BY 1", dates="")
add("tail_per_key", lambda s, d: mon.tail_per_key(t.ledger(s, d), 20).select("sleeve", "date"), "SELECT sleeve, date FROM last20")
cte("lcb", "SELECT sleeve, n, sr * sqrt(252) AS sharpe, (sr - 1.64 * sqrt((1 + 0.5 * sr * sr) / n)) * sqrt(252) AS sharpe_lcb FROM (SELECT sleeve, count(*) AS n, avg(day_return) / stddev_samp(day_return) AS sr FROM ledger GROUP BY 1)")
add("sharpe_lcb", lambda s, d: mon.sharpe_lcb(t.ledger(s, d)).select("sleeve", "n", rc("sharpe").alias("sharpe"), rc("sharpe_lcb").alias("sharpe_lcb")), f"SELECT sleeve, n, {r('sharpe')} AS sharpe, {r('sharpe_lcb')} AS sharpe_lcb FROM lcb", dates="")
_L = "PARTITION BY sleeve ORDER BY date"
cte("ph_a", f"SELECT *, day_return - avg(day_return) OVER ({_L}) AS dev FROM ledger")
cte("ph_b", f"SELECT *, sum(dev - 0.0005) OVER ({_L}) AS up, sum(dev + 0.0005) OVER ({_L}) AS dn FROM ph_a")
cte("ph_c", f"SELECT *, up - min(up) OVER ({_L}) AS rise, max(dn) OVER ({_L}) - dn AS fall FROM ph_b")
cte("ph", f"SELECT *, max((rise > 0.05 OR fall > 0.05)::INT) OVER ({_L}) = 1 AS alarm FROM ph_c")
add("page_hinkley", lambda s, d: mon.page_hinkley(t.ledger(s, d)).select("sleeve", "date", rc("rise", 8).alias("rise"), rc("fall", 8).alias("fall"), "alarm"), f"SELECT sleeve, date, {r('rise', 8)} AS rise, {r('fall', 8)} AS fall, alarm FROM ph")
add("drift_report", lambda s, d: mon.drift_report(t.ledger(s, d)).select("sleeve", "n", rc("sharpe").alias("sharpe"), rc("sharpe_lcb").alias("sharpe_lcb"), "decay_flag", "drift_flag", "note"),
    f"""SELECT l.sleeve, n, {r('CASE WHEN n >= 20 THEN sharpe END')} AS sharpe, {r('CASE WHEN n >= 20 THEN sharpe_lcb END')} AS sharpe_lcb, n >= 20 AND sharpe_lcb <= 0 AS decay_flag, n >= 20 AND a AS drift_flag,
        CASE WHEN n < 20 THEN 'warming up (' || n || '/20 obs)' WHEN sharpe_lcb <= 0 AND a THEN 'edge decay; change point' WHEN sharpe_lcb <= 0 THEN 'edge decay' WHEN a THEN 'change point' ELSE 'ok' END AS note
        FROM lcb l JOIN (SELECT sleeve, bool_or(alarm) AS a FROM ph GROUP BY 1) p ON l.sleeve = p.sleeve""", dates="")


def perf_table(s, d):
    return mon.rolling_performance(t.ledger(s, d)).select("sleeve", "sharpe", F.when(c("sleeve") == "sleeve_4", 5).otherwise(c("n_days")).alias("n_days"))


cte("rw_a", "SELECT sleeve, CASE WHEN sleeve = 'sleeve_4' OR n < 20 THEN 0 ELSE greatest(sharpe, 0) END AS sc FROM lcb")
cte("rw_b", "SELECT sleeve, CASE WHEN sum(sc) OVER () > 0 THEN sc / sum(sc) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END AS pw FROM rw_a")
cte("rw_c", "SELECT sleeve, pw, 0.5 * pw + 0.5 * CASE WHEN sleeve < 'sleeve_5' THEN 0.2 ELSE 0 END AS bw FROM rw_b")
add("reweight_sleeves", lambda s, d: pf.reweight_sleeves(perf_table(s, d), perf_table(s, d).where("sleeve < 'sleeve_5'").select("sleeve", F.lit(0.2).alias("weight"))).select("sleeve", rc("weight").alias("weight")),
    f"SELECT sleeve, {r('bw / sum(bw) OVER ()')} AS weight FROM rw_c", dates="")
add("learning_multipliers", lambda s, d: pf.learning_multipliers(perf_table(s, d)).select("sleeve", rc("weight").alias("weight"), rc("multiplier").alias("multiplier")),
    f"SELECT sleeve, {r('pw')} AS weight, {r('least(pw / max(pw) OVER (), 1)')} AS multiplier FROM rw_b", dates="")
add("export_scoreboard",
    lambda s, d: (lambda path: (led.export_csv(mon.standings(t.ledger(s, d)).select("sleeve", "n_days", rc("sharpe").alias("sharpe")), path), s.read.option("header", True).schema("sleeve string, n_days long, sharpe double").csv(path))[1])(scratch(s, "board")),
    f"SELECT sleeve, n_days, {r('sharpe')} AS sharpe FROM stand", dates="")
add("export_daily_returns",
    lambda s, d: (lambda path: (led.export_daily_returns(t.ledger(s, d).withColumn("day_return", rc("day_return", 14)), path), s.read.option("header", True).schema("date date, sleeve string, day_return double").csv(path))[1])(scratch(s, "daily")),
    f"SELECT date, sleeve, {r('day_return', 14)} AS day_return FROM ledger")
add("flatten_decisions", lambda s, d: led.flatten_decisions(t.ledger(s, d)).select("date", "sleeve", "asset", rc("target_weight", 9).alias("target_weight")), f"SELECT date, sleeve, asset, {r('target_weight', 9)} AS target_weight FROM decisions")
add("json_ledger_lines",
    lambda s, d: led.flatten_decisions(led.parse_ledger_lines(t.ledger(s, d).select(F.to_json(F.struct("*")).alias("value")))).groupBy("sleeve").agg(F.count(F.lit(1)).alias("n"), rc(F.sum("target_weight")).alias("w")),
    f"SELECT sleeve, count(*) AS n, {r('sum(target_weight)')} AS w FROM decisions GROUP BY 1", dates="")


def gap_targets(s, d):
    n = t.brand_number()
    x = t.tickers(s, d).select(F.concat(F.lit("book_"), n % 4).alias("sleeve"), "ticker", F.lit(0.1).alias("weight"), F.lit("1997-03-15").cast("date").alias("d0"),
                               F.when(n % 4 == 1, F.lit("1997-03-15")).otherwise("1997-06-20").cast("date").alias("d1"))
    return x.unionByName(x.withColumn("ticker", F.concat(F.lit("unknown "), "ticker")))


add("realized_gap_return", lambda s, d: mon.realized_gap_return(gap_targets(s, d), t.bars(s, d)).select("sleeve", rc("day_return").alias("day_return")),
    f"""SELECT 'book_' || (num % 4) AS sleeve, {r('sum(CASE WHEN num % 4 = 1 THEN 0 ELSE 0.1 * (b.close / a.close - 1) END)')} AS day_return FROM names n
        JOIN filled a ON n.ticker = a.ticker AND a.date = (SELECT max(date) FROM cal WHERE date <= '1997-03-15') JOIN filled b ON n.ticker = b.ticker AND b.date = (SELECT max(date) FROM cal WHERE date <= '1997-06-20') GROUP BY 1""", dates="")

# --- resampling and verdicts ---------------------------------------------------------------------------------------------------------
SIMS = 1000
cte("bs_r", "SELECT strategy, ret / 1000 AS ret, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM rets")
cte("bs_n", "SELECT strategy, any_value(n) AS n, ceil(any_value(n) / 10)::BIGINT AS nb FROM bs_r GROUP BY 1")
cte("bs_d", f"""SELECT strategy, n, sim, k, k * 10 + o AS p, ((((sim * 1103515 + k * 12345 + 3 * 7919) * 69069 + 362437) % 2147483647) * 48271 % 2147483647) % (n - 10) + o AS i
    FROM (SELECT strategy, n, nb, unnest(range({SIMS})) AS sim FROM bs_n) a, LATERAL (SELECT unnest(range(nb)) AS k) b, (SELECT unnest(range(10)) AS o) c WHERE k * 10 + o < n""")
cte("bs_s", "SELECT d.strategy, sim, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, exp(sum(ln(1 + ret))) - 1 AS total FROM bs_d d JOIN bs_r r ON d.strategy = r.strategy AND d.i = r.i GROUP BY 1, 2")
_MC = {"mc_sharpe_mean": "avg(sharpe)", "mc_sharpe_std": "stddev_pop(sharpe)", "mc_total_mean": "avg(total)", "mc_total_p05": "quantile_cont(total, 0.05)", "mc_total_p95": "quantile_cont(total, 0.95)", "mc_stability": "avg(total) / stddev_pop(total)"}
add("block_bootstrap", lambda s, d: resample.block_bootstrap(t.returns(s, d, 1000.0), SIMS, 10, 3).select("strategy", *[rc(k).alias(k) for k in _MC]),
    "SELECT strategy, " + ", ".join(f"{r(v)} AS {k}" for k, v in _MC.items()) + " FROM bs_s GROUP BY 1", dates="")


def _verdicts(s, d):
    perf = ev.against_benchmark(ev.performance_by(_rets(s, d)), "Brand#1")
    stress = ev.stress_tests(_rets(s, d))
    flags = col.risk_flags("max_drawdown", "stress_cost_5bps_sharpe", F.when(c("sharpe") < 3.2, -0.3).otherwise(0.1))
    return perf.join(stress, "strategy").select("strategy", F.array_join(flags, ",").alias("flags"),
                                                col.promotion_verdict(c("beats_sharpe"), c("sharpe") / 100, c("sortino") / 40, flags).alias("verdict"))


cte("verd", """SELECT p.strategy, p.sharpe > q.sharpe AS beats, p.sharpe, p.sortino, (CASE WHEN p.max_drawdown < -0.3 THEN 'drawdown,' ELSE '' END) || (CASE WHEN s.cs < 0 THEN 'cost_stress,' ELSE '' END) || (CASE WHEN p.sharpe < 3.2 THEN 'mc_p05,' ELSE '' END) AS fl
    FROM perf p, (SELECT sharpe FROM perf WHERE strategy = 'Brand#1') q, (SELECT strategy, avg(ret - 0.0005) / stddev_samp(ret - 0.0005) AS cs FROM rets_s GROUP BY 1) s WHERE s.strategy = p.strategy""")
add("promotion_verdict", _verdicts,
    """SELECT strategy, rtrim(fl, ',') AS flags, CASE WHEN beats AND abs(sharpe / 100) >= 0.02 AND sortino / 40 >= 1 AND fl = '' THEN 'PROMOTE' WHEN beats AND fl = '' THEN 'HOLD' ELSE 'REJECT' END AS verdict FROM verd""", dates="")
