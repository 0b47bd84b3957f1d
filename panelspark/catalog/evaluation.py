"""Queries over regimes, splits, audit and evaluation statistics."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import columns as col
from ..functions.windows import add_features, ordered
from ..session import stored
from ..operators import cross_section as xs
from ..operators import evaluate as ev
from ..operators import joins, regime as rg, relative, splits, technical as tech
from ..plans.panel import select_families
from ..sources import tables as t
from .base import add, cte, r, rc
from .features import W, roll
from .relational import _fold_ics, _labels, pct_sql

c = F.col
D = "PARTITION BY 1 ORDER BY date"


def _bench(s, d):
    return t.benchmark(s, d).select("date", "close")


# --- regimes -------------------------------------------------------------------------------------------
cte("rg_a", f"SELECT *, close / lag(close) OVER ({D}) - 1 AS r1 FROM bench")
cte("rg_b", f"SELECT *, {roll('stddev_samp', 'r1', 20, D)} AS rv, {roll('avg', 'close', 200, D)} AS ma, close / ({roll('max', 'close', 252, D)}) - 1 AS dd, close / lag(close, 60) OVER ({D}) - 1 AS mom FROM rg_a")
cte("rg_c", f"SELECT *, list(rv) FILTER (WHERE rv IS NOT NULL) OVER ({D} ROWS 251 PRECEDING) AS win, ma - lag(ma, 20) OVER ({D}) AS slope FROM rg_b")
cte("rg_d", "SELECT *, CASE WHEN len(win) = 252 THEN len(list_filter(win, lambda y: y <= rv)) / 252 END AS vol_pct, coalesce(close > ma, false) AS above FROM rg_c")
cte("regime2", """SELECT date, above::INT::DOUBLE AS bull, vol_pct, CASE WHEN vol_pct <= 1.0::DOUBLE / 3 THEN 0.0::DOUBLE WHEN vol_pct <= 2.0::DOUBLE / 3 THEN 1 WHEN vol_pct IS NOT NULL THEN 2 END AS vol_state,
    coalesce(above AND vol_pct <= 2.0::DOUBLE / 3, false)::INT::DOUBLE AS risk_on FROM rg_d""")
cte("regime_lab", """SELECT *, CASE WHEN vol_state IS NULL THEN 'unknown' ELSE (CASE WHEN bull >= 0.5 THEN 'bull' ELSE 'bear' END) || '-' ||
    (CASE vol_state WHEN 0 THEN 'calm' WHEN 1 THEN 'normal' ELSE 'stressed' END) END AS regime FROM regime2""")
cte("regime6", """SELECT date, CASE WHEN ma IS NULL OR vol_pct IS NULL THEN 'unknown' WHEN dd <= -0.15 AND vol_pct >= 0.8 THEN 'crisis' WHEN vol_pct >= 0.8 THEN 'high_vol'
    WHEN above AND slope > 0 AND vol_pct < 0.66 THEN 'bull' WHEN NOT above AND mom > 0 AND dd > -0.15 THEN 'recovery' WHEN NOT above AND slope < 0 THEN 'bear' ELSE 'chop' END AS regime FROM rg_d""")
add("classify_regime", lambda s, d: rg.classify_regime(_bench(s, d)).select("date", "bull", rc("vol_pct").alias("vol_pct"), "vol_state", "risk_on"),
    f"SELECT date, bull, {r('vol_pct')} AS vol_pct, vol_state, risk_on FROM regime2")


def _labels2(s, d):
    return rg.classify_regime(_bench(s, d)).withColumn("regime", rg.regime_label())


add("regime_label", lambda s, d: _labels2(s, d).select("date", "regime"), "SELECT date, regime FROM regime_lab")
add("classify_regime_6", lambda s, d: rg.classify_regime_6(_bench(s, d)),
    "SELECT date, regime, CASE regime WHEN 'bull' THEN 1 WHEN 'recovery' THEN 0.7 WHEN 'chop' THEN 0.5 WHEN 'high_vol' THEN 0.3 WHEN 'bear' THEN 0.2 ELSE 0 END::DOUBLE AS exposure FROM regime6")


def _vix(s, d):
    ref = t.references(s, d).where("ref = 'PROMO'").select("date", c("close").alias("_p"))
    return _bench(s, d).join(ref, "date").select("date", "close", (150 * c("_p") / c("close")).alias("vix"))


cte("vrp_a", f"SELECT b.date, b.close, 150 * x.close / b.close AS vix, b.close / lag(b.close) OVER (PARTITION BY 1 ORDER BY b.date) - 1 AS r1 FROM bench b JOIN refs x ON b.date = x.date AND x.ref = 'PROMO'")
cte("vrp_b", f"SELECT *, ({roll('stddev_samp', 'r1', 21, D)}) * sqrt(252) * 100 AS rv FROM vrp_a")
cte("vrp_c", f"SELECT *, vix - rv AS vrp, list(vix - rv) OVER ({D} ROWS 251 PRECEDING) AS win FROM vrp_b WHERE rv IS NOT NULL")
cte("vrp_d", "SELECT *, len(list_filter(win, lambda y: y <= vrp)) / 252 AS p FROM vrp_c WHERE len(win) = 252")
add("vrp_state", lambda s, d: rg.vrp_state(_vix(s, d)).select("date", rc("vix", 4).alias("vix"), rc("realized_vol", 4).alias("realized_vol"), rc("vrp", 4).alias("vrp"), rc("vrp_pct").alias("vrp_pct"), "state", "mult"),
    f"""SELECT date, {r('vix', 4)} AS vix, {r('rv', 4)} AS realized_vol, {r('vrp', 4)} AS vrp, {r('p')} AS vrp_pct,
        CASE WHEN p >= 0.5 THEN 'risk_on' WHEN p >= 0.25 THEN 'neutral' ELSE 'risk_off' END AS state, CASE WHEN p >= 0.5 THEN 1 WHEN p >= 0.25 THEN 0.6 ELSE 0.3 END::DOUBLE AS mult FROM vrp_d""")
add("macro_risk_off", lambda s, d: t.macro(s, d).select("date", rg.macro_risk_off().alias("risk_off")),
    "SELECT date, coalesce(T10Y2Y < 0, false) OR coalesce(NFCI > 0, false) AS risk_off FROM macro")


def _gated(s, d):
    x = rg.classify_regime(_bench(s, d)).join(_bench(s, d), "date")
    w = rg._spec(())
    x = x.withColumn("ret", col.safe_div(c("close"), F.lag("close").over(w)) - 1)
    return rg.gated_returns(x, "ret", "risk_on")


add("gated_returns", lambda s, d: _gated(s, d).select("date", rc("gated").alias("gated")),
    f"SELECT date, {r('gated')} AS gated FROM (SELECT a.date, r1 * coalesce(lag(risk_on) OVER (PARTITION BY 1 ORDER BY a.date), 0) AS gated FROM rg_a a JOIN regime2 g ON a.date = g.date) WHERE gated IS NOT NULL")
_REF = {"stock": "STANDARD", "bond": "LARGE", "high_yield": "MEDIUM", "grade": "SMALL", "vix": "PROMO", "vix3m": "ECONOMY"}


def _votes(s, d):
    wide = t.references(s, d).groupBy("date").agg(*[F.max(F.when(c("ref") == v, c("close"))).alias(k) for k, v in _REF.items()])
    return rg.regime_votes(wide.join(relative.mature_breadth(t.bars_filled(s, d)), "date"))


# a name counts once it has 200 closes of its own; a date without such a name has no vote
cte("mature", f"""SELECT date, avg(CASE WHEN k >= 200 THEN (close > m)::INT END) AS share FROM (SELECT date, close, count(close) OVER ({W}) AS k,
    avg(close) OVER ({W} ROWS 199 PRECEDING) AS m FROM filled) GROUP BY date""")
cte("vote_in", "SELECT x.date, " + ", ".join(f"max(CASE WHEN ref = '{v}' THEN close END) AS {k}" for k, v in _REF.items())
    + ", any_value(share) AS breadth_share FROM refs x JOIN mature b ON x.date = b.date GROUP BY x.date")
cte("vote_a", f"SELECT *, high_yield / nullif(grade, 0) AS q, stock / lag(stock) OVER ({D}) - 1 AS rs, bond / lag(bond) OVER ({D}) - 1 AS rb FROM vote_in")
cte("vote_b", f"""SELECT *, count(q) OVER ({D}) AS nq, lag(q, 49) OVER ({D}) AS q49, count(rs + rb) OVER ({D}) AS nb,
    CASE WHEN count(rs + rb) OVER ({D} ROWS 62 PRECEDING) = 63 THEN corr(CASE WHEN rb IS NOT NULL THEN rs END, CASE WHEN rs IS NOT NULL THEN rb END) OVER ({D} ROWS 62 PRECEDING) END AS k FROM vote_a""")
cte("vote_c", """SELECT date, CASE WHEN vix > 0 AND vix3m IS NOT NULL THEN CASE WHEN vix3m / vix >= 1 THEN 1 ELSE -1 END END::DOUBLE AS vix_term,
    CASE WHEN nq > 55 AND q IS NOT NULL THEN CASE WHEN q > q49 THEN 1 ELSE -1 END END::DOUBLE AS credit, CASE WHEN breadth_share >= 0.5 THEN 1 WHEN breadth_share < 0.5 THEN -1 END::DOUBLE AS breadth_vote,
    CASE WHEN nb > 63 AND k IS NOT NULL THEN CASE WHEN k > 0.3 THEN -1 ELSE 1 END END::DOUBLE AS stock_bond_corr FROM vote_b""")
cte("vote_d", "SELECT *, list_avg(list_filter([vix_term, credit, breadth_vote, stock_bond_corr], lambda v: v IS NOT NULL)) AS score FROM vote_c")
add("regime_votes", lambda s, d: _votes(s, d).select("date", "vix_term", "credit", "breadth_vote", "stock_bond_corr", rc("score").alias("score"), "state", "mult"),
    f"""SELECT date, vix_term, credit, breadth_vote, stock_bond_corr, {r('score')} AS score, CASE WHEN score >= 0.25 THEN 'risk_on' WHEN score <= -0.25 THEN 'risk_off' ELSE 'neutral' END AS state,
        CASE WHEN score >= 0.25 THEN 1 WHEN score <= -0.25 THEN 0.3 ELSE 0.6 END::DOUBLE AS mult FROM vote_d WHERE score IS NOT NULL""")

# --- rank correlation ---------------------------------------------------------------------------------------


def _pairs(s, d):
    return joins.score_target_join(t.filing_scores(s, d).select("date", "ticker", "score"), _labels(s, d))


cte("ranked_pairs", f"SELECT date, ticker, ({pct_sql('score')}) AS rx, ({pct_sql('target')}) AS ry FROM pairs")
cte("ics", "SELECT date, corr(rx, ry) AS ic FROM ranked_pairs GROUP BY date HAVING count(*) > 1 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0")
add("rank_ic_by_date", lambda s, d: ev.rank_ic_by_date(_pairs(s, d), names=t.n_names(s, d)).select("date", rc("ic").alias("ic")), f"SELECT date, {r('ic')} AS ic FROM ics")
add("ic_summary", lambda s, d: ev.ic_summary(ev.rank_ic_by_date(_pairs(s, d), names=t.n_names(s, d)), horizon=5).select(*[rc(x).alias(x) for x in ("ic_mean", "ic_std", "icir", "icir_overlap_adj")]),
    f"SELECT {r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std, {r('avg(ic) / stddev_samp(ic) * sqrt(252)')} AS icir, {r('avg(ic) / stddev_samp(ic) * sqrt(252.0::DOUBLE / 5)')} AS icir_overlap_adj FROM ics", dates="")
add("ic_by_year", lambda s, d: ev.ic_by_year(ev.rank_ic_by_date(_pairs(s, d), names=t.n_names(s, d))).select("year", rc("ic_mean").alias("ic_mean")),
    f"SELECT year(date)::BIGINT AS year, {r('avg(ic)')} AS ic_mean FROM ics GROUP BY 1", dates="")
add("ic_by_regime", lambda s, d: ev.ic_by_regime(ev.rank_ic_by_date(_pairs(s, d), names=t.n_names(s, d)), _labels2(s, d)).select("regime", rc("ic_mean").alias("ic_mean"), "n_days"),
    f"SELECT regime, {r('avg(ic)')} AS ic_mean, count(*) AS n_days FROM ics i JOIN regime_lab g ON i.date = g.date GROUP BY 1", dates="")
cte("decay_in", f"SELECT s.date, ticker, score, h AS horizon, CASE h " + " ".join(f"WHEN {h} THEN lead(close, {h}) OVER (PARTITION BY ticker, h ORDER BY s.date)" for h in (5, 10, 20, 40, 60, 120))
    + " END / close - 1 AS fwd FROM scored s, (SELECT unnest([5, 10, 20, 40, 60, 120]) AS h)")
cte("decay_ok", "SELECT * FROM decay_in WHERE score IS NOT NULL AND fwd IS NOT NULL")
cte("decay_rk", f"SELECT horizon, date, {pct_sql('score', 'horizon, date')} AS rx, {pct_sql('fwd', 'horizon, date')} AS ry FROM decay_ok")
add("signal_decay", lambda s, d: ev.signal_decay(t.filing_scores(s, d), t.bars_filled(s, d), names=t.n_names(s, d)).select("horizon", rc("ic_mean").alias("ic_mean")),
    f"SELECT horizon::BIGINT AS horizon, {r('avg(ic)')} AS ic_mean FROM (SELECT horizon, date, corr(rx, ry) AS ic FROM decay_rk GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1", dates="")
add("ic_significance", lambda s, d: ev.ic_significance(_fold_ics(s, d, False)).select(rc("mean", 8).alias("mean"), rc("std", 8).alias("std"), rc("t_stat").alias("t_stat"), "n_folds"),
    f"SELECT {r('avg(ic)', 8)} AS mean, {r('stddev_samp(ic)', 8)} AS std, {r('avg(ic) / (stddev_samp(ic) / sqrt(count(*)))')} AS t_stat, count(*) AS n_folds FROM fold_base", dates="")
add("source_verdict", lambda s, d: ev.source_verdict(_fold_ics(s, d, False), _fold_ics(s, d, True)).select("n_folds", rc("mean_gain").alias("mean_gain"), rc("t_stat").alias("t_stat"), "passed", "verdict"),
    f"""SELECT n AS n_folds, {r('m')} AS mean_gain, {r('ts')} AS t_stat, m > 0.002 AND ts > 2 AS passed,
        CASE WHEN n < 3 THEN 'INSUFFICIENT_FOLDS' WHEN m > 0.002 AND ts > 2 THEN 'PASS' WHEN m < -0.002 THEN 'HURTS' ELSE 'NO_EDGE' END AS verdict FROM (
        SELECT count(*) AS n, avg(full_ic - base) AS m, avg(full_ic - base) / (stddev_samp(full_ic - base) / sqrt(count(*))) AS ts FROM paired)""", dates="")

# --- feature correlation --------------------------------------------------------------------------------------
_FEATS = {"mom_20": "mom20", "mom_60": "mom60", "rel_volume": "rv", "boll_z": "bz", "realized_vol_20": "v20"}
cte("fpanel", f"""SELECT f.date, f.pos, f.ticker, ln(close) - ln(lag(close, 20) OVER ({W})) AS mom20, ln(close) - ln(lag(close, 60) OVER ({W})) AS mom60,
    volume / ({roll('avg', 'volume', 20)}) AS rv, (close - ({roll('avg', 'close', 20)})) / ({roll('stddev_samp', 'close', 20)}) AS bz,
    ({roll('stddev_samp', 'r1', 20)}) * sqrt(252) AS v20 FROM px2 f""")
cte("fpanel_y", "SELECT p.*, fwd, target FROM fpanel p JOIN labels l ON p.date = l.date AND p.ticker = l.ticker")


def feature_panel(s, d, h: int = 5):
    """Five features and the market-neutral label: the panel of the model queries."""
    p = add_features(t.bars_filled(s, d), [tech.log_momentum(20), tech.log_momentum(60), tech.rel_volume(), tech.bollinger_z(), tech.realized_vol(20), xs.forward_return(h)])
    return xs.demean_target(p).select("date", "pos", "ticker", *_FEATS, "target")


_pairs_sql = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({_FEATS[a]}, {_FEATS[b]}) AS k FROM fpanel"
    for i, a in enumerate(_FEATS) for b in list(_FEATS)[i + 1:])
add("feature_corr", lambda s, d: ev.feature_corr(feature_panel(s, d), list(_FEATS)).select("a", "b", rc("corr").alias("corr")), f"SELECT a, b, {r('k')} AS corr FROM ({_pairs_sql})", dates="")
add("redundancy", lambda s, d: ev.redundancy(feature_panel(s, d), list(_FEATS), 0.3).select("a", "b", rc("corr").alias("corr")), f"SELECT a, b, {r('k')} AS corr FROM ({_pairs_sql}) WHERE abs(k) > 0.3", dates="")
add("rank_redundant_pairs",
    lambda s, d: ev.redundancy(feature_panel(s, d), list(_FEATS), 0.0).limit(3).select("a", "b", rc("corr").alias("corr")),
    f"SELECT a, b, {r('k')} AS corr FROM ({_pairs_sql}) ORDER BY abs(k) DESC LIMIT 3", dates="")
add("feature_target_corr",
    lambda s, d: ev.feature_target_corr(feature_panel(s, d).withColumn("leaky", c("target") * 2 + 1), [*_FEATS, "leaky"]).select("feature", rc("corr").alias("corr"), "leak"),
    " UNION ALL ".join(f"SELECT '{k}' AS feature, {r(f'corr({v}, target)')} AS corr, abs(corr({v}, target)) > 0.95 AS leak FROM fpanel_y" for k, v in {**_FEATS, "leaky": "target * 2 + 1"}.items()), dates="")
_names = list(_FEATS)
# each feature asks those before it, so the columns of one row build on each other
add("prune_correlated",
    lambda s, d: (lambda p: s.createDataFrame([(f,) for f in ev.prune_correlated(p, list(_FEATS), 0.3)], "feature string"))(feature_panel(s, d)),
    "WITH " + ", ".join([f"pk{j} AS (SELECT *, " + (" AND ".join(f"NOT (k{i} AND c{i}_{j} > 0.3)" for i in range(j)) or "true") + f" AS k{j} FROM " + (f"pk{j - 1}" if j else "pk_corr") + ")" for j in range(len(_names))]).replace(
        "pk0 AS", "pk_corr AS (SELECT " + ", ".join(f"abs(corr({_FEATS[_names[i]]}, {_FEATS[_names[j]]})) AS c{i}_{j}" for j in range(len(_names)) for i in range(j)) + " FROM fpanel), pk0 AS", 1)
    + " SELECT feature FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, k{j} AS kept FROM pk{len(_names) - 1}" for j, f in enumerate(_names)) + ") WHERE kept", dates="")

# --- return series -----------------------------------------------------------------------------------------------
_P = ["n_days", "cagr", "ann_vol", "sharpe", "sortino", "win_rate", "log_growth", "max_drawdown", "calmar"]


def _rets(s, d):
    return t.returns(s, d, 100.0)


cte("rets_s", "SELECT strategy, date, ret / 100 AS ret FROM rets")
cte("navs", "SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS drawdown FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS nav FROM rets_s)")
cte("perf_a", """SELECT strategy, count(*) AS n_days, exp(sum(ln(1 + ret))) AS g, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS down,
    avg(CASE WHEN ret > 0 THEN 1 WHEN ret < 0 THEN 0 END) AS win_rate, min(drawdown) AS max_drawdown FROM navs GROUP BY 1""")
cte("perf", """SELECT strategy, n_days, pow(g, 252.0::DOUBLE / n_days) - 1 AS cagr, sd * sqrt(252) AS ann_vol, m / sd * sqrt(252) AS sharpe, m / down * sqrt(252) AS sortino, win_rate, g - 1 AS total_return, ln(g) AS log_growth,
    max_drawdown, (pow(g, 252.0::DOUBLE / n_days) - 1) / abs(max_drawdown) AS calmar FROM perf_a""")
_psql = ", ".join(f"{r(x)} AS {x}" for x in _P[1:])
add("return_metrics", lambda s, d: ev.performance_by(_rets(s, d)).withColumn("log_growth", F.log1p("total_return")).select("strategy", "n_days", *[rc(x).alias(x) for x in _P[1:]]), f"SELECT strategy, n_days, {_psql} FROM perf", dates="")
add("win_rate", lambda s, d: _rets(s, d).groupBy("strategy").agg(rc(ev.return_stats()["win_rate"]).alias("win_rate")), f"SELECT strategy, {r('win_rate')} AS win_rate FROM perf", dates="")
add("nav_drawdown", lambda s, d: ev.nav_drawdown(_rets(s, d)).select("strategy", "date", rc(F.log("nav")).alias("log_nav"), rc("drawdown").alias("drawdown")), f"SELECT strategy, date, {r('ln(nav)')} AS log_nav, {r('drawdown')} AS drawdown FROM navs")
add("performance_by", lambda s, d: ev.against_benchmark(ev.performance_by(_rets(s, d)), "Brand#1").select("strategy", rc("sharpe").alias("sharpe"), "beats_sharpe", "beats_return", "smaller_drawdown"),
    f"""SELECT p.strategy, {r('p.sharpe')} AS sharpe, p.sharpe > q.sharpe AS beats_sharpe, p.total_return > q.total_return AS beats_return, p.max_drawdown > q.max_drawdown AS smaller_drawdown
        FROM perf p, (SELECT * FROM perf WHERE strategy = 'Brand#1') q""", dates="")
add("cvar", lambda s, d: ev.cvar(_rets(s, d)).select("strategy", rc("var", 8).alias("var"), rc("cvar", 8).alias("cvar")),
    f"SELECT a.strategy, {r('any_value(v)', 8)} AS var, {r('avg(ret)', 8)} AS cvar FROM rets_s a JOIN (SELECT strategy, quantile_cont(ret, 0.05) AS v FROM rets_s GROUP BY 1) q ON a.strategy = q.strategy WHERE ret <= v GROUP BY 1", dates="")
cte("stress_q", "SELECT strategy, count(*) AS n, quantile_cont(ret, 0.01) AS q01, quantile_cont(ret, 0.95) AS q95, 0.4 * (120 / greatest(count(*) / 252, 1e-9)) * 0.0005 AS extra FROM rets_s GROUP BY 1")
cte("stress_r", "SELECT a.strategy, date, ret, extra, ret - extra / 252 AS rd, CASE WHEN ret <= q01 THEN 2 * ret ELSE ret END AS rt, CASE WHEN ret < q95 THEN ret END AS rl FROM rets_s a JOIN stress_q q ON a.strategy = q.strategy")
cte("stress_n", "SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + rt)) OVER (PARTITION BY strategy ORDER BY date)) AS nav FROM stress_r)")
add("stress_tests",
    lambda s, d: ev.stress_tests(_rets(s, d), t.tickers(s, d).select(c("ticker").alias("strategy"), F.lit(0.4).alias("avg_turnover"), F.lit(120).alias("n_rebalances"))).select(
        "strategy", *[rc(x).alias(x) for x in ("stress_cost_5bps_sharpe", "stress_cost_extra_annual", "stress_fattail_maxdd", "stress_no_luck_cagr")]),
    f"""SELECT strategy, {r('avg(rd) / stddev_samp(rd) * sqrt(252)')} AS stress_cost_5bps_sharpe, {r('any_value(extra)')} AS stress_cost_extra_annual, {r('min(dd)')} AS stress_fattail_maxdd,
        {r('exp(sum(ln(1 + rl)) * 252 / count(rl)) - 1')} AS stress_no_luck_cagr FROM stress_n GROUP BY 1""", dates="")


def _basket(s, d):
    cal = t.trading_calendar(s, d)
    last = cal.agg(F.max("pos")).scalar()
    return t.returns(s, d).join(cal, "date").where(c("pos") > last - 60).select(
        F.concat(F.lit("group_"), t.brand_number("strategy") % 4).alias("strategy"), "date", c("strategy").alias("ticker"), "ret")


cte("basket", "SELECT 'group_' || (num % 4) AS g, strategy AS ticker, e.date, ret FROM rets e JOIN names n ON e.strategy = n.ticker JOIN cal k ON e.date = k.date WHERE pos > (SELECT max(pos) FROM cal) - 60")
add("avg_pairwise_corr", lambda s, d: ev.avg_pairwise_corr(_basket(s, d)).select("strategy", "n_names", rc("avg_corr").alias("avg_corr"), "overload"),
    f"""SELECT g AS strategy, (SELECT count(DISTINCT ticker) FROM basket z WHERE z.g = p.g) AS n_names, {r('avg(k)')} AS avg_corr, avg(k) > 0.8 AS overload FROM (
        SELECT a.g, a.ticker, b.ticker AS other, corr(a.ret, b.ret) AS k FROM basket a JOIN basket b ON a.g = b.g AND a.date = b.date AND a.ticker <> b.ticker GROUP BY 1, 2, 3) p GROUP BY g""", dates="")
add("best_model",
    lambda s, d: ev.best_model(_fold_ics(s, d, False).withColumn("model", F.lit("plain")).unionByName(_fold_ics(s, d, True).withColumn("model", F.lit("sign")))).select("model", rc("ic_mean", 8).alias("ic_mean")),
    f"SELECT model, {r('m', 8)} AS ic_mean FROM (SELECT 'plain' AS model, avg(ic) AS m FROM fold_base UNION ALL SELECT 'sign', avg(ic) FROM fold_full) ORDER BY m DESC LIMIT 1", dates="")


def _sweep(s, d):
    """Planted signal of three strengths on every date; the year plays the seed."""
    base = _pairs(s, d)
    levels = F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0))).alias("strength")
    x = base.select("date", "ticker", "target", levels, c("score").alias("_s"))
    x = x.withColumn("score", c("_s") * 0.5 + c("strength") * c("target"))
    ics = ev.rank_ic_by_date(x, ["strength"])
    return ics.groupBy("strength", F.year("date").alias("seed")).agg(F.avg("ic").alias("ic"))


cte("sweep_in", "SELECT date, ticker, target, g AS strength, score * 0.5 + g * target AS sc FROM pairs, (SELECT unnest([0.0::DOUBLE, 1, 4]) AS g)")
cte("sweep_rk", f"SELECT strength, date, {pct_sql('sc', 'strength, date')} AS rx, {pct_sql('target', 'strength, date')} AS ry FROM sweep_in")
cte("sweep_ic", "SELECT strength, year(date) AS seed, avg(ic) AS ic FROM (SELECT strength, date, corr(rx, ry) AS ic FROM sweep_rk GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1, 2")
cte("sweep_st", "SELECT strength, avg(ic) AS mean, stddev_samp(ic) AS std, count(*) AS n FROM sweep_ic GROUP BY 1")
cte("sweep_v", """SELECT m1 > m0 AND m4 > m0 AND m4 >= m1 - s4 AS recovery, abs(m0) < greatest(0.04, 2.5 * s0 / sqrt(n0)) AND abs(m0) < 0.5 * greatest(m4, 1e-9) AS quiet FROM (
    SELECT max(mean) FILTER (WHERE strength = 0) AS m0, max(mean) FILTER (WHERE strength = 1) AS m1, max(mean) FILTER (WHERE strength = 4) AS m4, max(std) FILTER (WHERE strength = 4) AS s4,
    max(std) FILTER (WHERE strength = 0) AS s0, max(n) FILTER (WHERE strength = 0) AS n0 FROM sweep_st)""")
add("seed_sweep", lambda s, d: ev.seed_sweep(_sweep(s, d), ev.leak_canary(feature_panel(s, d))).select("strength", rc("mean").alias("mean"), rc("std").alias("std"), "n", "recovery", "no_hallucination", "leak_caught", "passed"),
    f"""SELECT strength, {r('mean')} AS mean, {r('std')} AS std, n, recovery, quiet AS no_hallucination, caught AS leak_caught, recovery AND quiet AND caught AS passed
        FROM sweep_st, sweep_v, (SELECT abs(corr(target * 0.5 + 3, target)) > 0.95 AS caught FROM fpanel_y)""", dates="")
add("crosscheck",
    lambda s, d: ev.crosscheck(_rets(s, d), _rets(s, d).withColumn("ret", c("ret") + F.when(F.month("date") == 3, 0.001).otherwise(0.0)).where(F.dayofweek("date") != 1), 1e-6).select("strategy", "n", rc("max_diff").alias("max_diff"), "ok"),
    f"SELECT strategy, count(*) AS n, {r('max(CASE WHEN month(date) = 3 THEN 0.001 ELSE 0 END)::DOUBLE')} AS max_diff, max(CASE WHEN month(date) = 3 THEN 0.001 ELSE 0 END) <= 1e-6 AS ok FROM rets_s WHERE isodow(date) <> 7 GROUP BY 1", dates="")

# --- splits ------------------------------------------------------------------------------------------------------
FOLD = dict(n_splits=5, train_min=252, test=120, embargo=5, horizon=10)


def _folds(s, d):
    return splits.walk_forward_folds(t.trading_calendar(s, d), **FOLD)


cte("folds", """SELECT (max(i) OVER () - i)::BIGINT AS fold, 0::BIGINT AS train_lo, n - i * 120 - 10 - 10 AS train_hi, n - i * 120 AS test_lo, n - (i - 1) * 120 AS test_hi
    FROM (SELECT (SELECT max(pos) + 1 FROM cal) AS n, unnest([1, 2, 3, 4, 5]) AS i) WHERE n - i * 120 - 20 >= 252""")
add("date_positions", lambda s, d: splits.date_positions(t.bars(s, d)), "SELECT date, pos FROM cal")
add("walk_forward_folds", _folds, "SELECT * FROM folds", dates="")
cte("sided", """SELECT f.*, fold, CASE WHEN pos >= test_lo AND pos < test_hi THEN 'test' ELSE 'train' END AS role FROM filled f JOIN folds k
    ON (pos >= test_lo AND pos < test_hi) OR (pos >= train_lo AND pos < train_hi AND pos + 10 < test_lo)""")
add("in_fold", lambda s, d: splits.in_fold(t.bars_filled(s, d), _folds(s, d), 10).select("fold", "role", "date", "ticker"), "SELECT fold, role, date, ticker FROM sided")
add("fold_stats", lambda s, d: splits.fold_stats(t.bars_filled(s, d), _folds(s, d), 10),
    """SELECT fold, min(CASE WHEN role = 'train' THEN date END) AS train_from, max(CASE WHEN role = 'train' THEN date END) AS train_to, min(CASE WHEN role = 'test' THEN date END) AS test_from,
       max(CASE WHEN role = 'test' THEN date END) AS test_to, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test FROM sided GROUP BY 1""", dates="train_from train_to test_from test_to")
add("purge", lambda s, d: splits.in_fold(t.trading_calendar(s, d), _folds(s, d).withColumn("train_hi", c("test_lo")), 10).where("role = 'train'").groupBy("fold").agg(F.max("pos").alias("last_train")),
    "SELECT fold, max(pos) AS last_train FROM cal, folds WHERE pos + 10 < test_lo GROUP BY 1", dates="")
add("train_intersect_test",
    lambda s, d: splits.train_test_overlap(t.bars_filled(s, d), _folds(s, d), 10).agg(F.count(F.lit(1)).alias("overlapping")),
    "SELECT count(*) AS overlapping FROM (SELECT fold, date FROM sided WHERE role = 'train' INTERSECT SELECT fold, date FROM sided WHERE role = 'test')", dates="")
add("leakage_audit",
    lambda s, d: splits.leakage_audit(feature_panel(s, d).withColumn("leaky", -c("target")), _folds(s, d).withColumn("train_hi", F.when(c("fold") == 1, c("test_hi")).otherwise(c("train_hi"))), [*_FEATS, "leaky"], 10, purge=False)
    .select("kind", "subject", rc("value").alias("value")),
    f"""SELECT 'feature_is_target' AS kind, 'leaky' AS subject, {r('corr(-target, target)')} AS value FROM fpanel_y HAVING abs(corr(-target, target)) > 0.95
        UNION ALL SELECT 'train_not_before_test', '1', datediff('day', max(CASE WHEN pos < test_hi THEN date END), min(CASE WHEN pos >= test_lo THEN date END))::DOUBLE FROM cal, folds WHERE fold = 1
        UNION ALL SELECT 'train_test_overlap', '1', count(*)::DOUBLE FROM cal, folds WHERE fold = 1 AND pos >= test_lo AND pos < test_hi""", dates="")
CUT = 1500


def _probed(bars):
    """All single-name features, the ranks, and one planted feature that reads the close three days ahead."""
    bench = bars.groupBy("date").agg(F.avg("close").alias("_bench"))
    levels = [*tech.single_name_features(), relative.relative_strength_column("rs_bench", "_bench"), relative.rolling_beta_levels("beta_bench", "_bench"),
              [{"planted": F.lead("close", 3).over(ordered()) / c("close")}]]
    p = add_features(relative.market_join(bars, bench), levels).drop("_bench")
    p = xs.add_ranked_signals(p, names=1000)
    features = [x for x in p.columns if x not in ("date", "pos", "ticker", "open", "high", "low", "close", "volume")]
    return p.select("date", "pos", "ticker", *[rc(x, 9).alias(x) for x in features])


add("lookahead_probe", lambda s, d: splits.lookahead_probe(stored(s, t.bars_filled(s, d), "bars"), _probed, CUT),
    f"""SELECT 'planted' AS feature, count(DISTINCT ticker) AS n_tickers, min(pos) AS first_pos FROM (
        SELECT ticker, pos, lead(pos, 3) OVER (PARTITION BY ticker ORDER BY date) AS reads FROM filled) WHERE pos <= {CUT} AND reads > {CUT}""", dates="")
add("select_families",
    lambda s, d: feature_panel(s, d).select("date", "ticker", *[rc(x).alias(x) for x in select_families(list(_FEATS), ["momentum", "volatility"])]),
    f"SELECT date, ticker, {r('mom20')} AS mom_20, {r('mom60')} AS mom_60, {r('v20')} AS realized_vol_20 FROM fpanel")
