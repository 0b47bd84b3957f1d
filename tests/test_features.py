import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import ranks, udfs
from panelspark.operators.evaluate import rank_ic_by_date
from panelspark.functions.ranks import quantile_bounds, quantile_bounds_split, rank_columns, rank_pct, rank_split
from panelspark.functions.windows import add_features, ewm_levels
from panelspark.operators import cross_section as xs
from panelspark.operators import relative, splits
from panelspark.operators import technical as tech


def one(pdf, name):
    return pdf[pdf.ticker == name].sort_values("date").reset_index(drop=True)


def result(df, name):
    return df.where(F.col("ticker") == name).orderBy("date").toPandas()


@pytest.fixture(scope="module")
def features(toy_bars):
    pdf, bars = toy_bars
    return pdf, tech.technical_features(bars).cache()


def true_range(p):
    prev = p.close.shift(1)
    return pd.concat([p.high - p.low, (p.high - prev).abs(), (p.low - prev).abs()], axis=1).max(axis=1)


@pytest.mark.parametrize("name", ["A", "D"])
def test_recursive_features_match_pandas(features, name):
    pdf, df = features
    p, got = one(pdf, name), result(df, name)
    ewm = lambda s, a: s.ewm(alpha=a, adjust=False).mean()
    d = p.close.diff()
    rsi = 100 - 100 / (1 + ewm(d.clip(lower=0), 1 / 14) / ewm(-d.clip(upper=0), 1 / 14))
    np.testing.assert_allclose(got.rsi.astype(float), rsi, rtol=1e-9)
    np.testing.assert_allclose(got.atr_pct, ewm(true_range(p), 1 / 14) / p.close, rtol=1e-9)
    ema = p.close.ewm(span=20, adjust=False).mean()
    np.testing.assert_allclose(got.ema_dist, (p.close - ema) / ema, rtol=1e-9, atol=1e-12)


def test_adx_matches_pandas(features):
    pdf, df = features
    p, got = one(pdf, "B"), result(df, "B")
    up, down = p.high.diff(), -p.low.diff()
    ewm = lambda s: pd.Series(s).ewm(alpha=1 / 14, adjust=False).mean()
    atr = ewm(true_range(p))
    plus = 100 * ewm(np.where((up > down) & (up > 0), up, 0.0)) / atr
    minus = 100 * ewm(np.where((down > up) & (down > 0), down, 0.0)) / atr
    dx = 100 * (plus - minus).abs() / (plus + minus).replace(0, np.nan)
    np.testing.assert_allclose(got.adx.astype(float), ewm(dx), rtol=1e-8)


def test_adaptive_average_and_supertrend_match_a_loop(features):
    pdf, df = features
    p, got = one(pdf, "C"), result(df, "C")
    change, noise = p.close.diff(10).abs(), p.close.diff().abs().rolling(10).sum()
    gain = ((change / noise.replace(0, np.nan)).fillna(0) * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    level, out = p.close[0], []
    for x, g in zip(p.close, gain):
        level += g * (x - level)
        out.append((x - level) / level)
    np.testing.assert_allclose(got.kama_dist, out, rtol=1e-7, atol=1e-12)
    atr = true_range(p).ewm(alpha=0.1, adjust=False).mean()
    mid, state, want = (p.high + p.low) / 2, 1, [1]
    for i in range(1, len(p)):
        if p.close[i] > (mid + 3 * atr)[i - 1]:
            state = 1
        elif p.close[i] < (mid - 3 * atr)[i - 1]:
            state = -1
        want.append(state)
    assert got.supertrend.tolist() == want


def test_rolling_features_match_pandas(features):
    pdf, df = features
    p, got = one(pdf, "A"), result(df, "A")
    r = p.close.pct_change()
    np.testing.assert_allclose(got.realized_vol_20.astype(float), r.rolling(20).std() * math.sqrt(252), rtol=1e-7)
    np.testing.assert_allclose(got.vol_of_vol.astype(float), r.rolling(20).std().rolling(20).std() * math.sqrt(252), rtol=1e-6)
    rank = p.close.rolling(60).apply(lambda x: (x < x[-1]).mean(), raw=True)
    np.testing.assert_allclose(got.pct_rank_60.astype(float), rank)
    assert got.mom_20.isna().sum() == 20


def test_ewm_over_a_history_longer_than_a_block(spark):
    n = 13000
    x = np.sin(np.arange(n) / 50.0) * 5 + 100
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": np.arange(n), "x": x}))
    got = add_features(df, [ewm_levels("y", F.col("x"), 1 / 14, "t")]).orderBy("date").toPandas()
    np.testing.assert_allclose(got.y, pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-11)


def test_ewm_skips_leading_nulls(spark):
    df = spark.createDataFrame([("A", i, None if i < 3 else float(i)) for i in range(30)], "ticker string, date int, x double")
    got = add_features(df, [ewm_levels("y", F.col("x"), 0.1, "t")]).orderBy("date").toPandas()
    want = pd.Series([np.nan] * 3 + [float(i) for i in range(3, 30)]).ewm(alpha=0.1, adjust=False).mean()
    np.testing.assert_allclose(got.y.astype(float), want, rtol=1e-12)


def test_no_feature_looks_ahead(toy_bars):
    _, bars = toy_bars
    probe = splits.lookahead_probe(bars, lambda b: tech.technical_features(b).select(
        "date", "pos", "ticker", *[F.round(x, 8).alias(x) for x in ("mom_20", "adx", "hull_dist", "obv_z", "yang_zhang_vol", "rsi")]), 300)
    assert probe.isEmpty()
    from pyspark.sql import Window
    leak = lambda b: b.withColumn("f", F.lead("close").over(Window.partitionBy("ticker").orderBy("date"))).select("date", "pos", "ticker", "f")
    assert [tuple(r) for r in splits.lookahead_probe(bars, leak, 300).collect()] == [("f", 4, 300)]
    two = lambda b: leak(b).withColumn("g", F.when(F.col("ticker") == "B", F.lead("f", 99).over(Window.partitionBy("ticker").orderBy("date"))))
    assert {tuple(r) for r in splits.lookahead_probe(bars, two, 300).collect()} == {("f", 4, 300), ("g", 1, 201)}


def test_ranks_average_ties_and_split_ranks_agree(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"date": rng.integers(0, 3, 4000), "id": range(4000), "x": rng.integers(0, 300, 4000).astype(float)})
    pdf.loc[rng.random(4000) < 0.4, "x"] = 7.0  # one value holds a large share
    pdf.loc[rng.random(4000) < 0.05, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    plain = df.withColumn("p", rank_pct("x")).orderBy("id").toPandas()
    want = pdf.groupby("date").x.rank(pct=True)
    np.testing.assert_allclose(plain.p.astype(float), want, rtol=1e-12)
    split = rank_split(df, {"q": "x"}, ["date"], ["id"]).orderBy("id").toPandas()
    np.testing.assert_allclose(split.q.astype(float), want, rtol=1e-12)


def skewed_dates(spark, n=6000):
    """Three dates, the first with most rows; columns with ties, zeros of both signs, tiny and huge values, gaps."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"date": np.where(rng.random(n) < 0.8, 0, rng.integers(1, 3, n)), "id": range(n), "a": rng.normal(0, 1, n), "b": rng.integers(-3, 3, n) / 2,
                        "d": np.exp(rng.normal(0, 200, n)) * rng.choice([-1, 1], n), "e": np.where(rng.random(n) < 0.5, 0.0, -0.0)})
    pdf.loc[rng.random(n) < 0.6, "b"] = 7.0
    pdf.loc[pdf.date == 2, "d"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    df = spark.createDataFrame(pdf).repartition(6)
    return pdf, df.replace(float("nan"), None)


def test_large_dates_are_split_with_the_same_ranks(spark, monkeypatch):
    pdf, df = skewed_dates(spark)
    wanted = {f"r_{x}": (x, ("date",)) for x in "abde"}
    want = pdf.groupby("date")[list("abde")].rank(pct=True)
    for limit in (ranks.GROUP_ROWS, 100):
        monkeypatch.setattr(ranks, "GROUP_ROWS", limit)
        got = rank_columns(df, wanted, ("id",)).orderBy("id").toPandas()
        np.testing.assert_allclose(got[list(wanted)].astype(float), want, rtol=1e-12)
        assert list(got.columns) == [*df.columns, *wanted]


@pytest.mark.parametrize("p", [0.01, 0.05, 0.5])
def test_radix_selection_equals_the_exact_quantiles(spark, p):
    _, df = skewed_dates(spark)
    one = df.where("date < 2").unionByName(df.where("date = 2").limit(1))  # a group of one row, and one without values
    want = {r.date: r for r in quantile_bounds(one, list("abde"), p).collect()}
    got = {r.date: r for r in quantile_bounds_split(one, list("abde"), p).collect()}
    assert set(got) == set(want)
    for date, row in want.items():
        for x in "abde":
            a, b = got[date][f"_q_{x}"], row[f"_q_{x}"]
            assert (a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=1e-14, atol=0))


def test_large_dates_are_winsorised_alike(spark, monkeypatch):
    _, df = skewed_dates(spark)
    want = xs.winsorize(df, ["a", "b", "d"], 0.05, names=10).orderBy("id").toPandas()
    monkeypatch.setattr(xs, "GROUP_ROWS", 100)
    got = xs.winsorize(df, ["a", "b", "d"], 0.05).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, want, rtol=1e-13)


def test_large_dates_have_the_same_rank_correlation(spark, monkeypatch):
    _, df = skewed_dates(spark)
    pairs = df.select("date", F.col("id").alias("ticker"), F.col("a").alias("score"), (F.col("a") + F.col("b")).alias("target"))
    want = {r.date: r.ic for r in rank_ic_by_date(pairs, names=10).collect()}
    monkeypatch.setattr(ranks, "GROUP_ROWS", 100)
    got = {r.date: r.ic for r in rank_ic_by_date(pairs).collect()}
    assert got == pytest.approx(want, rel=1e-12) and len(got) == 3


def test_breadth_counts_names_in_warm_up(toy_bars):
    _, bars = toy_bars
    first = relative.breadth(bars).orderBy("date").first()
    assert first.breadth_pct_above_20 == 0.0 and first.breadth_new_highs == 0.0
    early = relative.breadth(bars).where("date = date'2020-03-02'").first()
    assert early.breadth_pct_above_20 in (0.0, 0.25, 0.5, 0.75)  # the late name counts in the denominator


def test_features_share_one_exchange_and_few_sorts(spark, toy_bars):
    pdf, _ = toy_bars
    df = tech.technical_features(spark.createDataFrame(pdf).where("volume > 0"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") <= 7


def test_empty_and_single_ticker(spark, toy_bars):
    _, bars = toy_bars
    assert tech.technical_features(bars.where("ticker = 'none'")).count() == 0
    assert tech.technical_features(bars.where("ticker = 'A'")).count() == 420


@pytest.mark.parametrize("batch", [10_000, 9])
def test_windows_of_a_user_function_cross_batches(spark, batch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"ticker": np.repeat(["a", "b", "c"], [120, 4, 61]), "date": np.concatenate([np.arange(120), np.arange(4), np.arange(61)]), "x": rng.normal(0, 1, 185)})
    pdf.loc[[30, 31, 150], "x"] = np.nan
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))

    def spread(windows):
        assert windows.shape[1] == 5 and not np.isnan(windows).any()
        return windows.max(axis=1) - windows.min(axis=1)

    try:
        got = udfs.rolling_apply(spark.createDataFrame(pdf), spread, "x", 5, "y").toPandas().sort_values(["ticker", "date"], ignore_index=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    roll = pdf.groupby("ticker").x.rolling(5)
    np.testing.assert_allclose(got.y.astype(float), (roll.max() - roll.min()).to_numpy(), rtol=1e-12)
