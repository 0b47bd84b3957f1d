"""Queries over models: moments, folds, ablation, gates."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import linear as lin
from ..operators import regime as rg
from ..operators import trees
from ..session import stored
from ..sources import tables as t
from .base import add, cte, r, rc
from .evaluation import _FEATS, _bench, _folds, feature_panel

c = F.col
NAMES = list(_FEATS)
H = 10


def panel(s, d):
    """Complete rows of the five-feature panel with a 10-day label."""
    return feature_panel(s, d, H).dropna()


def kept_panel(s, d):
    """The panel as a written table, for what reads it once per fold or model."""
    return stored(s, panel(s, d), "panel")


cte("mlabels", "SELECT date, ticker, fwd - avg(fwd) OVER (PARTITION BY date) AS y FROM (SELECT date, ticker, lead(close, 10) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM filled)")
cte("mpanel", "SELECT p.*, y FROM fpanel p JOIN mlabels l ON p.date = l.date AND p.ticker = l.ticker WHERE y IS NOT NULL AND " + " AND ".join(f"{v} IS NOT NULL" for v in _FEATS.values()))
_cols = ["1.0::DOUBLE", *_FEATS.values(), "y"]
add("gram_blocks",
    lambda s, d: lin.gram_blocks(panel(s, d).withColumn("segment", F.year("date")), NAMES).select("segment", c("i").cast("long").alias("i"), c("j").cast("long").alias("j"), rc("value", 4).alias("value")),
    " UNION ALL ".join(f"SELECT year(date)::BIGINT AS segment, {i}::BIGINT AS i, {j}::BIGINT AS j, {r(f'sum({_cols[i]} * {_cols[j]})', 4)} AS value FROM mpanel GROUP BY 1"
                       for i in range(len(_cols)) for j in range(i, len(_cols))), dates="")
cte("ftrain", "SELECT fold, p.* FROM mpanel p JOIN folds k ON pos < least(train_hi, test_lo - 10)")
cte("fstat", "SELECT fold, count(*) AS n, avg(bz) AS mx, stddev_pop(bz) AS sx, avg(y) AS my, covar_pop(bz, y) AS cxy FROM ftrain GROUP BY 1")


def _one(s, d, solver):
    coefs = lin.fit_folds(panel(s, d), NAMES, _folds(s, d), H, {solver: (solver, ["boll_z"])})
    return coefs.select("fold", rc("std_coef", 9).alias("std_coef"), rc("coef", 9).alias("coef"), rc("intercept", 9).alias("intercept"))


for _solver, _w in (("ridge", "cxy / sx / (1 + 10.0::DOUBLE / n)"), ("elasticnet", "sign(cxy) * greatest(abs(cxy / sx) - 0.0005, 0) / (1 + 0.0005::DOUBLE)")):
    add(f"{_solver}_single", (lambda k: lambda s, d: _one(s, d, k))(_solver),
        f"SELECT fold, {r('w', 9)} AS std_coef, {r('w / sx', 9)} AS coef, {r('my - w / sx * mx', 9)} AS intercept FROM (SELECT *, {_w} AS w FROM fstat)", dates="")


def _two(s, d):
    coefs = lin.fit_folds(panel(s, d), NAMES, _folds(s, d), H, {"ridge": ("ridge", ["boll_z", "mom_20"])})
    return coefs.select("fold", "feature", rc("std_coef", 9).alias("std_coef"))


cte("fstat2", "SELECT fold, count(*) AS n, corr(bz, mom20) AS k, covar_pop(bz, y) / stddev_pop(bz) AS a, covar_pop(mom20, y) / stddev_pop(mom20) AS b FROM ftrain GROUP BY 1")
add("ridge", _two,
    f"""SELECT fold, 'boll_z' AS feature, {r('(a * q - k * b) / (q * q - k * k)', 9)} AS std_coef FROM (SELECT *, 1 + 10.0::DOUBLE / n AS q FROM fstat2)
        UNION ALL SELECT fold, 'mom_20', {r('(b * q - k * a) / (q * q - k * k)', 9)} FROM (SELECT *, 1 + 10.0::DOUBLE / n AS q FROM fstat2)""", dates="")


def _predict_one(s, d):
    scores, _ = lin.walk_forward_predict(kept_panel(s, d), NAMES, _folds(s, d), H, {"ridge": ("ridge", ["boll_z"])})
    return scores.select("model", "fold", "date", "ticker", rc("score", 8).alias("score"))


add("walk_forward_predict", _predict_one,
    f"""WITH wf_days AS MATERIALIZED (SELECT fold, unnest(range(test_lo, test_hi)) AS pos FROM folds), wf_rows AS MATERIALIZED (SELECT date, pos, ticker, bz FROM mpanel),
        wf_fit AS MATERIALIZED (SELECT * FROM fstat)
        SELECT 'ridge' AS model, k.fold, p.date, p.ticker, {r('my + cxy / sx / (1 + 10.0::DOUBLE / n) * (bz - mx) / sx', 8)} AS score
        FROM wf_rows p JOIN wf_days k ON p.pos = k.pos JOIN wf_fit s ON s.fold = k.fold""")


def _wf(s, d):
    return lin.walk_forward_predict(kept_panel(s, d), NAMES, _folds(s, d), H)


add("elasticnet", lambda s, d: _wf(s, d)[1].where("model = 'elasticnet'").select("fold", "feature", rc("std_coef").alias("std_coef")))
add("fold_rank_ics", lambda s, d: lin.fold_ics(_wf(s, d)[0]))
add("model_significance", lambda s, d: lin.model_significance(_wf(s, d)[0]))
add("importance_top", lambda s, d: lin.importance_top(lin.fit_folds(kept_panel(s, d), NAMES, _folds(s, d), H, {"ridge": ("ridge", ["boll_z", "mom_20"])}), 15).select("model", "feature", rc("importance", 9).alias("importance")),
    f"""SELECT 'ridge' AS model, feature, {r('avg(abs(w))', 9)} AS importance FROM (SELECT unnest(['boll_z', 'mom_20']) AS feature, unnest([(a * q - k * b) / (q * q - k * k), (b * q - k * a) / (q * q - k * k)]) AS w
        FROM (SELECT *, 1 + 10.0::DOUBLE / n AS q FROM fstat2)) GROUP BY 2""", dates="")


def elasticnet_optimal(s, d):
    """Per fold: do the coefficients meet the conditions of the optimum on the fold's training rows, recomputed from the rows?

    Every coefficient other than 0 has a gradient of ``alpha l1 sign(w)``, every 0 one of at most ``alpha l1``.
    """
    p, alpha, l1 = kept_panel(s, d), 0.001, 0.5
    coefs = lin.fit_folds(p, NAMES, _folds(s, d), H, {"elasticnet": ("elasticnet", NAMES)})
    out = []
    for f in _folds(s, d).collect():  # a handful of folds
        out.append(p.where(c("pos") < lin.train_end(f, H)).withColumn("fold", F.lit(f.fold).cast("long")))
    rows = reduce(DataFrame.unionByName, out)
    wide = coefs.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("coef", "std_coef").alias("w")))).alias("_w"), F.first("intercept").alias("_b"))
    fitted = rows.join(F.broadcast(wide), "fold")  # one row per fold
    miss = c("target") - c("_b") - sum(c(x) * c("_w")[x]["coef"] for x in NAMES)
    # covariance of the residual with each standardised feature is the gradient left over
    grads = fitted.withColumn("_e", miss).groupBy("fold").agg(*[(F.covar_pop("_e", x) / F.stddev_pop(x)).alias(f"g_{x}") for x in NAMES], F.first("_w").alias("_w"))
    fits = [F.when(c("_w")[x]["std_coef"] != 0, F.abs(c(f"g_{x}") - alpha * (1 - l1) * c("_w")[x]["std_coef"] - alpha * l1 * F.signum(c("_w")[x]["std_coef"])) < 1e-9)
            .otherwise(F.abs(c(f"g_{x}")) <= alpha * l1 + 1e-9) for x in NAMES]
    return grads.select("fold", reduce(lambda a, b: a & b, fits).alias("optimal"))


add("elasticnet_optimal", elasticnet_optimal, "SELECT DISTINCT fold, true AS optimal FROM ftrain", dates="")
add("score_latest", lambda s, d: lin.score_latest(feature_panel(s, d, H).dropna(subset=NAMES), NAMES))
_FAMS = {"momentum": ["mom_20", "mom_60"], "volume": ["rel_volume"], "mean_reversion": ["boll_z"], "volatility": ["realized_vol_20"]}
add("ablation", lambda s, d: lin.ablation(kept_panel(s, d), _FAMS, _folds(s, d), H))
add("source_gate", lambda s, d: lin.source_gate(kept_panel(s, d), ["mom_20", "realized_vol_20"], ["boll_z"], _folds(s, d), H))
add("stack", lambda s, d: lin.stack(kept_panel(s, d), NAMES, _folds(s, d), H)[0])
add("stack_weights", lambda s, d: lin.stack(kept_panel(s, d), NAMES, _folds(s, d), H)[1])
add("random_forest", lambda s, d: trees.walk_forward_trees(kept_panel(s, d), NAMES, _folds(s, d), H, lambda: trees.random_forest(), "rf"))
add("boosted_trees", lambda s, d: trees.walk_forward_trees(kept_panel(s, d), NAMES, _folds(s, d), H, lambda: trees.boosted_trees(rounds=20), "xgb"))


def macro_gate(s, d):
    """Buy-and-hold, price regime and price plus macro regime on the benchmark."""
    from ..operators.joins import calendar_left_join
    from ..plans.gates import macro_gate as gate
    risk_off = t.macro(s, d).select("date", rg.macro_risk_off().alias("risk_off"))
    return gate(_bench(s, d), risk_off)


cte("mg_macro", "SELECT date, coalesce(last_value(ro IGNORE NULLS) OVER (PARTITION BY 1 ORDER BY date), false) AS ro FROM (SELECT c.date, CASE WHEN m.date IS NOT NULL THEN coalesce(T10Y2Y < 0, false) OR coalesce(NFCI > 0, false) END AS ro FROM cal c LEFT JOIN macro m ON c.date = m.date)")
cte("mg_in", "SELECT a.date, r1 / 100 AS r1, risk_on AS p, CASE WHEN risk_on = 1 AND NOT ro THEN 1.0::DOUBLE ELSE 0 END AS q FROM rg_a a JOIN regime2 g ON a.date = g.date JOIN mg_macro m ON a.date = m.date")
cte("mg_all", """SELECT 'buy_hold' AS strategy, date, r1 AS ret FROM mg_in WHERE r1 IS NOT NULL
    UNION ALL SELECT * FROM (SELECT 'price_regime', date, r1 * coalesce(lag(p) OVER (PARTITION BY 1 ORDER BY date), 0) AS ret FROM mg_in) WHERE ret IS NOT NULL
    UNION ALL SELECT * FROM (SELECT 'macro_regime', date, r1 * coalesce(lag(q) OVER (PARTITION BY 1 ORDER BY date), 0) AS ret FROM mg_in) WHERE ret IS NOT NULL""")
cte("mg_nav", "SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY date)) AS nav FROM mg_all)")
cte("mg_perf", "SELECT strategy, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END AS sharpe, min(dd) AS mdd FROM mg_nav GROUP BY 1")
cte("mg_wide", "SELECT max(sharpe) FILTER (WHERE strategy = 'macro_regime') AS ms, max(sharpe) FILTER (WHERE strategy = 'price_regime') AS ps, max(sharpe) FILTER (WHERE strategy = 'buy_hold') AS bs, max(mdd) FILTER (WHERE strategy = 'macro_regime') AS md, max(mdd) FILTER (WHERE strategy = 'price_regime') AS pd FROM mg_perf")
add("macro_gate", lambda s, d: macro_gate(s, d).select(*[rc(x).alias(x) for x in ("buy_hold_sharpe", "price_sharpe", "macro_sharpe", "sharpe_gain", "dd_gain")], "passed"),
    f"""SELECT {r('bs')} AS buy_hold_sharpe, {r('ps')} AS price_sharpe, {r('ms')} AS macro_sharpe, {r('ms - ps')} AS sharpe_gain, {r('md - pd')} AS dd_gain,
        coalesce((ms - ps >= 0.05) OR (md - pd >= 0.02 AND ms - ps >= -0.01), false) AS passed FROM mg_wide""", dates="")
