"""Books of the daily run: own features per book, crowded baskets, caps, books without a model."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from panelspark.operators import linear as lin
from panelspark.plans.books import BOOKS, Book, basket_overload, book_panel, build_books, decide_books, score_books

TWO = [Book("one", 0.70, 0.08), Book("two", 0.60, 0.20, {15: 0.6, 5: 0.4}, 0.5, 0.5, "experimental"), Book("none", 0.5, 0.1)]


@pytest.fixture(scope="module")
def market(spark):
    """Eight names on 400 days; even ones belong to the first book, odd ones to the second."""
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2021-01-01", periods=400)
    frames = []
    for k in range(8):
        close = 50 * np.exp(np.cumsum(rng.normal(0.0002 * k, 0.01 + 0.002 * k, len(days))))
        spread = np.abs(rng.normal(0, 0.4, len(days))) + 0.05
        frames.append(pd.DataFrame({"date": days.date, "pos": np.arange(len(days)), "ticker": f"N{k}", "open": close - spread / 3, "high": close + spread, "low": close - spread,
                                    "close": close, "volume": rng.integers(1, 100, len(days)).astype(float)}))
    bars = spark.createDataFrame(pd.concat(frames)).cache()
    number = F.substring("ticker", 2, 1).cast("int")
    assignment = bars.select("ticker").distinct().withColumn("book", F.when(number % 2 == 0, "one").otherwise("two"))
    sectors = bars.select("ticker").distinct().withColumn("sector", F.when(number < 4, "low").otherwise("high"))
    return bars, bars.groupBy("date").agg(F.avg("close").alias("close")), assignment, sectors


@pytest.fixture(scope="module")
def panel(market):
    bars, bench, assignment, sectors = market
    df, features = book_panel(bars, bench, assignment, [5, 15, 20, 60], sectors)
    return df.cache(), features


def test_each_book_prunes_its_own_features_and_fits_its_labelled_rows(panel):
    df, features = panel
    scores, fits = score_books(df, features, TWO, 0.7)
    pdf, got = df.toPandas(), {(r.book, r.horizon): r for r in fits.collect()}
    assert set(got) == {("one", 60), ("one", 20), ("two", 15), ("two", 5), ("none", 60), ("none", 20)} and got["none", 60].n_rows == 0
    for name in ("one", "two"):
        part = pdf[pdf.book == name]
        corr, kept = part[features].corr().abs(), []
        for f in features:
            if all(corr.loc[f, k] <= 0.7 for k in kept):
                kept.append(f)
        for b in TWO[:2]:
            for h in b.horizons:
                if b.name == name:
                    assert got[name, h].features == kept and got[name, h].n_rows == part[f"t_{h}"].notna().sum()
    assert len(got["one", 60].features) < len(features)
    # the blend is the weighted mean of the ranks each horizon's own model gives
    want, last = {}, pdf[pdf.pos == pdf.pos.max()]
    for name, h, share in (("two", 15, 0.6), ("two", 5, 0.4)):
        kept, part = got[name, h].features, pdf[(pdf.book == name)].dropna(subset=[f"t_{h}"])
        spark = df.sparkSession
        m = lin.segment_moments(spark.createDataFrame(part[kept].assign(target=part[f"t_{h}"], segment=1)), kept)[1]
        intercept, coef = lin.raw_units(m, lin.elasticnet(m))
        today = last[last.book == name].set_index("ticker")
        rank = (today[kept] @ pd.Series(coef)).rank(pct=True) - 0.5
        for ticker, v in rank.items():
            want[ticker] = want.get(ticker, 0) + share * v
    assert {r.ticker: r.score for r in scores.where("book = 'two'").collect()} == pytest.approx(want, abs=1e-12)


def test_ranks_are_inside_book_and_sector(panel, market):
    df, _ = panel
    sectors = {r.ticker: r.sector for r in market[3].collect()}
    pdf = df.toPandas()
    day = pdf[pdf.pos == 300].assign(sector=lambda p: p.ticker.map(sectors))
    for _, part in day.groupby(["book", "sector"]):
        assert sorted(part.csrank_mom) == [0.0, 0.5]  # two names each
    assert day.groupby(["book", "sector"]).t_5.sum().abs().max() < 1e-12


def test_crowded_baskets_halve_the_weights(spark, market):
    bars, bench, assignment, _ = market
    twin = bars.where("ticker = 'N1'").withColumn("ticker", F.lit("N9"))  # moves exactly like N1
    both, books = bars.unionByName(twin), assignment.unionByName(spark.createDataFrame([("N9", "two")], "ticker string, book string"))
    last = bars.agg(F.max("date")).first()[0]
    scores = spark.createDataFrame([("two", last, n, s) for n, s in (("N1", 0.4), ("N9", 0.3), ("N3", 0.1), ("N5", 0.05))], "book string, date date, ticker string, score double")
    over = basket_overload(scores, both, books, F.lit(0.5)).collect()
    assert [(r.book, round(r.avg_corr, 9), r.overload) for r in over] == [("two", 1.0, True)]
    calm = bench.withColumn("close", 100 + F.row_number().over(Window.orderBy("date")) * 0.01)
    wide = Book("two", 0.6, 1.0, {5: 1.0}, 0.5, 0.5)
    crowded = {r.ticker: r.target_weight for r in decide_books(scores, both, calm, books, [wide]).collect()}
    free = {r.ticker: r.target_weight for r in decide_books(scores, both, calm, books, [wide], crowded=1.1).collect()}
    assert sum(free.values()) > 0 and crowded == pytest.approx({k: v / 2 for k, v in free.items()}, abs=1e-4)


def test_caps_hold_and_a_book_without_model_says_so(market):
    bars, bench, assignment, sectors = market
    out = build_books(bars, bench, assignment, TWO, sectors=sectors, microcaps=assignment.select("ticker").where("ticker = 'N0'")).toPandas()
    unfit = out[out.book == "none"]
    assert len(unfit) == 1 and unfit.iloc[0].action == "NO TRADE" and unfit.iloc[0].reasoning == "no_model" and unfit.iloc[0].weight == 0
    sums = out.groupby("book").weight.sum()
    assert sums["one"] <= 0.70 + 1e-12 and sums["two"] <= 0.05 + 1e-12 and (out[out.book == "one"].weight <= 0.08 + 1e-12).all()
    assert (out[out.ticker == "N0"].weight <= 0.01).all() and set(out[out.book == "one"].ticker) == {"N0", "N2", "N4", "N6"}


def test_books_keep_their_fixed_values():
    assert [b.name for b in BOOKS] == ["stocks", "crypto", "metals", "bonds", "aggressive"] and all(abs(sum(b.horizons.values()) - 1) < 1e-12 for b in BOOKS)


def test_daily_run_logs_once_and_governs(spark, market):
    from panelspark.plans.daily import MARKET, SYSTEM, daily_run
    from panelspark.sources.ledger import LEDGER_SCHEMA
    bars, bench, assignment, _ = market
    days = [r.date for r in bars.select("date").distinct().orderBy("date").collect()]
    scores = spark.createDataFrame([("one", days[-1], f"N{k}", 0.1 * (k + 1)) for k in (0, 2, 4, 6)] + [("two", days[-1], f"N{k}", 0.1) for k in (1, 3, 5, 7)],
                                   "book string, date date, ticker string, score double")
    entry = [("N0", "BUY", 0.1, "LOW", 90.0, 0.5, "", ""), ("N2", "SELL", 0.1, "LOW", 90.0, 0.0, "", "")]
    ledger = spark.createDataFrame(
        [(days[-30 + i], "one", "shadow", 1, 0.001 * (i % 3), entry) for i in range(10)] + [(days[-30 + i], "two", "shadow", 1, -0.05, entry) for i in range(8)], LEDGER_SCHEMA)
    fresh, summary = daily_run(ledger, bars, bench, assignment, TWO, scores=scores, caps={"one": 0.3, "two": 0.2})
    got = {r.sleeve: r for r in summary.collect()}
    price = {(r.date, r.ticker): r.close for r in bars.where(F.col("ticker") == "N0").collect()}
    assert set(got) == {"one", "two", SYSTEM, MARKET} and all(r.logged for r in got.values())
    assert got["one"].day_return == pytest.approx(0.5 * (price[days[-1], "N0"] / price[days[-21], "N0"] - 1)) and got["one"].n_days == 11
    assert got["two"].exposure == 0 and got["two"].governor == "drawdown" and got["two"].n_positions == 0  # eight losses of 5 %
    assert got[MARKET].exposure == 1 and got[MARKET].day_return is None and got[SYSTEM].exposure <= 0.3 + 1e-9
    again, repeated = daily_run(ledger.unionByName(fresh.select(*ledger.columns)), bars, bench, assignment, TWO, scores=scores, caps={"one": 0.3, "two": 0.2})
    assert again.isEmpty() and not any(r.logged or r.day_return is not None for r in repeated.collect())
