"""Centred co-moments: digits, unknown values, merging, pruning."""
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import evaluate as ev
from panelspark.operators import linear as lin
from panelspark.operators.moments import CoMoments, co_moments, collect_co_moments, greedy_prune


def exact(x, y):
    """Sum of products about the means, in rationals."""
    x, y = [Fraction(v) for v in x], [Fraction(v) for v in y]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return float(sum((a - mx) * (b - my) for a, b in zip(x, y)))


@pytest.mark.parametrize("mean", [0.0, 1e8, -3e11])
def test_large_means_keep_their_digits(spark, mean):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 4000) + mean
    y = 0.5 * (x - mean) + rng.normal(0, 1, 4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "target": y - x + mean})).repartition(7)
    m = collect_co_moments(df, ["x", "y"])[0]
    assert m.n.tolist() == [[4000, 4000], [4000, 4000]]
    assert m.co[0, 1] == pytest.approx(exact(x, y), rel=1e-12) and m.var[0, 0] == pytest.approx(exact(x, x), rel=1e-12)
    fitted = lin.segment_moments(df.selectExpr("*", "1 AS segment"), ["x", "y"])[1]
    _, means, scale, corr, cross, _ = fitted.centred()
    assert scale[0] == pytest.approx(np.sqrt(exact(x, x) / 4000), rel=1e-12) and corr[0, 1] == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-9)


def test_unknown_values_count_pair_by_pair(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, (3000, 4))
    x[:, 3] += x[:, 0]
    x[rng.random(x.shape) < 0.3] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(s=rng.integers(0, 3, 3000))
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)
    states = collect_co_moments(df, list("abcd"), "s")
    for s, part in pdf.groupby("s"):
        np.testing.assert_allclose(states[s].corr(), part[list("abcd")].corr(), rtol=1e-10)
    whole = {(r.a, r.b): r["corr"] for r in ev.feature_corr(df, list("abcd")).collect()}
    want = pdf[list("abcd")].corr()
    assert whole == {(a, b): pytest.approx(want.loc[a, b], rel=1e-10) for i, a in enumerate("abcd") for b in "abcd"[i + 1:]}


def test_merging_in_any_order_gives_the_whole():
    x = np.random.default_rng(3).normal(1e6, 1, (500, 3))
    whole = CoMoments.of(x)
    for cuts in ([1, 2, 3], [250], [0, 499]):
        state = None
        for part in np.split(x, cuts):
            if len(part):
                state = state.merge(CoMoments.of(part)) if state else CoMoments.of(part)
        np.testing.assert_allclose(state.co, whole.co, rtol=1e-11)
        np.testing.assert_allclose(state.origin[:, None] + state.mean, whole.origin[:, None] + whole.mean, rtol=1e-15)


def test_constant_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert [r["corr"] for r in ev.feature_corr(df, ["a", "b"]).collect()] == [None]
    assert ev.prune_correlated(df, ["b", "a"]) == ["b"] and ev.prune_correlated(df.limit(0), ["a", "b"]) == ["a", "b"]
    assert co_moments(df.limit(0), ["a", "b"]).count() == 0


def test_pruning_is_greedy_in_order():
    corr = np.array([[1, 0.95, 0.2], [0.95, 1, 0.92], [0.2, 0.92, 1]])
    assert greedy_prune(corr, ["a", "b", "c"]) == ["a", "c"] and greedy_prune(corr[1:, 1:], ["b", "c"]) == ["b"]
