"""Linear models from one distributed pass of second moments.

Expanding walk-forward training sets are unions of date segments. One pass over the panel gives the
moment matrix of every segment; the training moments of any fold, any feature subset and any linear
model follow from those K x K blocks without touching the rows again.
"""
from __future__ import annotations

from typing import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_match
from .evaluate import ic_significance, rank_ic_by_date, source_verdict
from .moments import CoMoments, co_moments, collect_co_moments

c = F.col


# --- moments -----------------------------------------------------------------------------------------------


def gram_blocks(panel: DataFrame, features: Sequence[str], target: str = "target", segment: str = "segment") -> DataFrame:
    """``(segment, i, j, value)``: sums of products of [1, features..., target], upper triangle.

    Read off the centred moments of the complete rows (:mod:`moments`), one row per segment.
    """
    cols = [*features, target]
    k = len(cols)
    m = co_moments(panel.dropna(subset=cols), cols, segment)
    n = c("n")[0]
    mean = [F.lit(1.0), *[c("origin")[i] + c("mean")[i * k + i] for i in range(k)]]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (n * mean[i] * mean[j] + (c("co")[(i - 1) * k + j - 1] if i else 0.0)).alias("value"))
             for i in range(k + 1) for j in range(i, k + 1)]
    return m.select("segment", F.inline(F.array(*cells)))


class Moments:
    """Centred moments of complete rows of features and target (the last column); K x K numbers on the driver."""

    def __init__(self, features: Sequence[str], state: CoMoments | None):
        self.features = list(features)
        self.state = state

    @property
    def n(self) -> float:
        return float(self.state.n[0, 0]) if self.state else 0.0

    @property
    def means(self) -> np.ndarray:
        return self.state.origin + np.diag(self.state.mean)

    def centred(self, subset: Sequence[str] | None = None):
        """Means, scales, standardised covariance and covariance with the target of a feature subset."""
        names = list(subset or self.features)
        at = [self.features.index(f) for f in names]
        mean, cov = self.means, self.state.co / self.n
        scale = np.sqrt(np.clip(np.diag(cov)[at], 0, None))
        scale = np.where(scale > 0, scale, 1.0)
        return names, mean[at], scale, cov[np.ix_(at, at)] / np.outer(scale, scale), cov[at, -1] / scale, mean[-1]


def segment_moments(panel: DataFrame, features: Sequence[str], segment: str = "segment", target: str = "target") -> dict[int, Moments]:
    """Moments of the complete rows of every segment, from one pass."""
    cols = [*features, target]
    return {s: Moments(features, m) for s, m in collect_co_moments(panel.dropna(subset=cols), cols, segment).items()}


# --- solvers: K x K problems ---------------------------------------------------------------------------------


def ridge(m: Moments, subset: Sequence[str] | None = None, alpha: float = 10.0) -> np.ndarray:
    """Ridge on standardised features; coefficients per standard deviation."""
    _, _, _, corr, cross, _ = m.centred(subset)
    return np.linalg.solve(corr + alpha / m.n * np.eye(len(corr)), cross)


def elasticnet(m: Moments, subset: Sequence[str] | None = None, alpha: float = 0.001, l1: float = 0.5,
               max_iter: int = 5000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent on the covariance form of the elastic net."""
    _, _, _, corr, cross, _ = m.centred(subset)
    w = np.zeros(len(cross))
    for _ in range(max_iter):
        shift = 0.0
        for k in range(len(w)):
            if corr[k, k] <= 0:
                continue
            rho = cross[k] - corr[k] @ w + corr[k, k] * w[k]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (corr[k, k] + alpha * (1 - l1))
            shift, w[k] = max(shift, abs(new - w[k])), new
        if shift < tol:
            return w
    raise ArithmeticError(f"coordinate descent has not converged after {max_iter} rounds")


def nonnegative_ridge(m: Moments, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """min |y - b - Zw|^2 + alpha |w|^2 with w >= 0: weights and intercept; Z has one column per base.

    Active set: free the base that gains most, solve the free ones, and bind again what turns negative. The
    problem is strictly convex, so no set returns and the walk ends.
    """
    at = np.arange(len(m.features))
    mean, y_mean = m.means[:-1], m.means[-1]
    gram = m.state.co[:-1, :-1] + alpha * np.eye(len(at))
    rhs = m.state.co[:-1, -1]
    w, free = np.zeros(len(at)), np.zeros(len(at), bool)
    small = 1e-10 * max(np.abs(rhs).max(initial=0.0), 1e-300)
    while True:
        gain = np.where(free, -np.inf, rhs - gram @ w)
        if gain.max(initial=-np.inf) <= small:
            return w, float(y_mean - mean @ w)
        free[gain.argmax()] = True
        while True:
            solved = np.zeros(len(at))
            solved[free] = np.linalg.solve(gram[np.ix_(free, free)], rhs[free])
            bad = free & (solved <= 0)
            if not bad.any():
                w = solved
                break
            step = (w[bad] / (w[bad] - solved[bad])).min()
            w = w + step * (solved - w)
            free &= w > 1e-15 * np.abs(w).max()
            w[~free] = 0.0


LINEAR_MODELS: Mapping[str, Callable] = {"ridge": ridge, "elasticnet": elasticnet}


def raw_units(m: Moments, w: np.ndarray, subset: Sequence[str] | None = None) -> tuple[float, dict[str, float]]:
    names, mean, scale, _, _, y_mean = m.centred(subset)
    coef = w / scale
    return float(y_mean - coef @ mean), dict(zip(names, coef))


# --- folds -----------------------------------------------------------------------------------------------------


def train_end(fold, horizon: int) -> int:
    """First position the training side may not use (gap and purge)."""
    return min(fold.train_hi, fold.test_lo - horizon)


def segment_of(pos: Column, edges: Sequence[int]) -> Column:
    """Number of edges at or below the position."""
    marks = F.array(*[F.lit(int(e)).cast("long") for e in edges])
    return F.size(F.filter(marks, lambda e: e <= pos))


def training_moments(panel: DataFrame, features: Sequence[str], ends: Sequence[int]) -> dict[int, Moments]:
    """Moments of all rows before each end position, from one pass over the panel."""
    edges = sorted(set(ends))
    by_segment = segment_moments(panel.withColumn("segment", segment_of(c("pos"), edges)), features)
    out, state = {}, None
    for i, e in enumerate(edges):
        if i in by_segment:
            state = state.merge(by_segment[i].state) if state else by_segment[i].state
        out[e] = Moments(features, state)
    return out


def coefficient_table(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "model string, fold long, feature string, coef double, std_coef double, intercept double")


def fit_folds(panel: DataFrame, features: Sequence[str], folds: DataFrame, horizon: int,
              models: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Coefficients ``(model, fold, feature, coef, std_coef, intercept)``.

    ``models``: name -> (solver, features). ``folds`` is a handful of rows.
    """
    fold_rows = folds.collect()
    moments = training_moments(panel, features, [train_end(f, horizon) for f in fold_rows])
    rows = []
    for f in fold_rows:
        m = moments[train_end(f, horizon)]
        for name, (solver, subset) in models.items():
            w = LINEAR_MODELS[solver](m, subset)
            intercept, coef = raw_units(m, w, subset)
            rows += [(name, f.fold, k, float(v), float(s), intercept) for (k, v), s in zip(coef.items(), w)]
    return coefficient_table(panel.sparkSession, rows)


def test_fold(pos: Column, folds: Sequence) -> Column:
    """Fold whose test window holds the position; windows do not overlap."""
    return first_match([((pos >= f.test_lo) & (pos < f.test_hi), F.lit(f.fold).cast("long")) for f in folds], None)


def score_linear(rows: DataFrame, coefs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Dot product of every row with every model of its fold.

    The coefficient table has (models x folds) rows, independent of the data, hence the broadcast; the
    join key is the fold, so a row meets its own models only.
    """
    wide = coefs.groupBy("model", "fold").agg(
        F.first("intercept").alias("_b"),
        F.map_from_entries(F.collect_list(F.struct("feature", "coef"))).alias("_m")).select(
        "model", "fold", "_b", F.array(*[F.coalesce(F.try_element_at("_m", F.lit(f)), F.lit(0.0)) for f in features]).alias("_w"))
    joined = rows.join(F.broadcast(wide), "fold")
    dot = F.aggregate(F.zip_with(F.array(*features), c("_w"), lambda x, w: x * w), c("_b"), lambda a, v: a + v)
    return joined.withColumn("score", dot).select("model", "fold", "date", "pos", "ticker", "score", "target")


def walk_forward_predict(panel: DataFrame, features: Sequence[str], folds: DataFrame, horizon: int,
                         models: Mapping[str, tuple[str, Sequence[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-sample scores of all models and their coefficients: one fitting and one scoring pass."""
    models = models or {k: (k, features) for k in LINEAR_MODELS}
    coefs = fit_folds(panel, features, folds, horizon, models)
    test = panel.withColumn("fold", test_fold(c("pos"), folds.collect())).where("fold IS NOT NULL")
    return score_linear(test, coefs, features), coefs


def fold_ics(scores: DataFrame) -> DataFrame:
    """Mean daily rank correlation per model and fold."""
    daily = rank_ic_by_date(scores, ["model", "fold"])
    return daily.groupBy("model", "fold").agg(F.avg("ic").alias("ic"))


def importance_top(coefs: DataFrame, n: int = 15) -> DataFrame:
    """Features by mean absolute standardised coefficient over folds."""
    return coefs.groupBy("model", "feature").agg(F.avg(F.abs("std_coef")).alias("importance")).orderBy(
        c("importance").desc(), "model", "feature").limit(n)


def score_latest(panel: DataFrame, features: Sequence[str], solver: str = "elasticnet") -> DataFrame:
    """Fit on all labelled rows, score the last date (whose label is still unknown)."""
    last = panel.agg(F.max("pos").alias("p")).first().p
    m = training_moments(panel, features, [last + 1])[last + 1]
    w = LINEAR_MODELS[solver](m)
    intercept, coef = raw_units(m, w)
    rows = [(solver, 0, k, float(v), float(s), intercept) for (k, v), s in zip(coef.items(), w)]
    today = panel.where(c("pos") == last).withColumn("fold", F.lit(0).cast("long"))
    return score_linear(today, coefficient_table(panel.sparkSession, rows), features).drop("fold", "target")


# --- ablation and gates ------------------------------------------------------------------------------------------


def ablation(panel: DataFrame, families: Mapping[str, Sequence[str]], folds: DataFrame, horizon: int,
             solver: str = "elasticnet", edge: float = 0.002) -> DataFrame:
    """Per family: stand-alone and leave-one-out rank correlation and what the family adds.

    Every variant is a sub-matrix of the same moments, and one scoring pass serves all variants.
    """
    features = [f for fs in families.values() for f in fs]
    models = {"full": (solver, features)}
    for name, fs in families.items():
        rest = [f for f in features if f not in fs]
        models[f"only:{name}"] = (solver, list(fs))
        if rest:
            models[f"without:{name}"] = (solver, rest)
    scores, _ = walk_forward_predict(panel, features, folds, horizon, models)
    means = fold_ics(scores).groupBy("model").agg(F.avg("ic").alias("ic"))
    sizes = panel.sparkSession.createDataFrame([(k, len(v)) for k, v in families.items()], "family string, n int")
    kind, fam = F.split_part("model", F.lit(":"), F.lit(1)), F.split_part("model", F.lit(":"), F.lit(2))
    by_family = means.where("model <> 'full'").groupBy(fam.alias("family")).agg(
        F.max(F.when(kind == "only", c("ic"))).alias("standalone_ic"),
        F.max(F.when(kind == "without", c("ic"))).alias("ic_without"))
    full = means.where("model = 'full'").agg(F.max("ic").alias("full_ic"))
    out = sizes.join(by_family, "family").withColumn("full_ic", full.scalar())
    out = out.withColumn("marginal_ic", c("full_ic") - c("ic_without"))
    verdict = first_match([(c("marginal_ic") > edge, "ADDS"), (c("marginal_ic") < -edge, "HURTS")], "neutral")
    return out.withColumn("verdict", verdict)


def source_gate(panel: DataFrame, baseline: Sequence[str], candidate: Sequence[str], folds: DataFrame, horizon: int,
                solver: str = "elasticnet") -> DataFrame:
    """Does adding the candidate features to the baseline pay on the same folds?"""
    both = [*baseline, *candidate]
    models = {"base": (solver, list(baseline)), "full": (solver, both)}
    scores, _ = walk_forward_predict(panel, both, folds, horizon, models)
    ics = fold_ics(scores)
    return source_verdict(ics.where("model = 'base'"), ics.where("model = 'full'"))


def model_significance(scores: DataFrame) -> DataFrame:
    return ic_significance(fold_ics(scores), ["model"])


# --- stacking ------------------------------------------------------------------------------------------------------


def stack(panel: DataFrame, features: Sequence[str], folds: DataFrame, horizon: int,
          bases: Sequence[str] = ("ridge", "elasticnet"), inner: int = 3) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold stacking with a non-negative meta model: scores and meta weights per fold.

    The inner folds follow the calendar and are purged like the outer ones. Three passes over the panel
    for all outer folds together: moments, out-of-fold predictions, final scores.
    """
    spark = panel.sparkSession
    outer = folds.collect()
    plan = []  # (outer fold, inner index, train end, validation lo, hi)
    for f in outer:
        end = train_end(f, horizon)
        step = end // (inner + 1)
        for i in range(inner):
            lo = end - (inner - i) * step
            plan.append((f.fold, i, max(lo - horizon, 1), lo, lo + step))
    ends = [p[2] for p in plan] + [train_end(f, horizon) for f in outer]
    moments = training_moments(panel, features, ends)

    def table(rows):
        out = []
        for key, end in rows:
            for b in bases:
                w = LINEAR_MODELS[b](moments[end])
                intercept, coef = raw_units(moments[end], w)
                out += [(b, key, k, float(v), float(s), intercept) for (k, v), s in zip(coef.items(), w)]
        return coefficient_table(spark, out)

    inner_coefs = table([(p[0] * inner + p[1], p[2]) for p in plan])
    spans = F.array_compact(F.array(*[
        F.when((c("pos") >= lo) & (c("pos") < hi), F.lit(o * inner + i).cast("long")) for o, i, _, lo, hi in plan]))
    oof_rows = panel.dropna(subset=["target", *features]).withColumn("fold", F.explode(spans))
    oof = score_linear(oof_rows, inner_coefs, features)
    wide = oof.groupBy(F.floor(c("fold") / inner).alias("segment"), "date", "ticker").agg(
        F.first("target").alias("target"), *[F.max(F.when(c("model") == b, c("score"))).alias(b) for b in bases])
    metas = segment_moments(wide, list(bases))
    meta_rows = []
    for f in outer:
        w, intercept = nonnegative_ridge(metas[f.fold]) if f.fold in metas else (np.zeros(len(bases)), 0.0)
        if np.allclose(w, 0.0):  # nothing survives: fall back to the plain average
            w, intercept = np.full(len(bases), 1.0 / len(bases)), 0.0
        meta_rows += [(f.fold, b, float(x), intercept) for b, x in zip(bases, w)]
    meta = spark.createDataFrame(meta_rows, "fold long, model string, weight double, meta_intercept double")
    test = panel.withColumn("fold", test_fold(c("pos"), outer)).where("fold IS NOT NULL")
    final = score_linear(test, table([(f.fold, train_end(f, horizon)) for f in outer]), features)
    scores = (
        final.join(F.broadcast(meta), ["fold", "model"])
        .groupBy("fold", "date", "pos", "ticker")
        .agg((F.sum(c("weight") * c("score")) + F.first("meta_intercept")).alias("score"), F.first("target").alias("target"))
    )
    return scores.withColumn("model", F.lit("stack")), meta
