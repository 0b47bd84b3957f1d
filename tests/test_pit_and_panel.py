import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import evaluate as ev
from panelspark.operators import fundamentals as fund
from panelspark.operators import joins, linear, splits
from panelspark.plans.panel import PanelConfig, build_panel, select_families
from panelspark.sources import bars as b
from panelspark.sources import filings as fil
from panelspark.sources import registry

D = dt.date


def test_filings_are_visible_from_their_filing_date(spark):
    days = [D(2021, 1, 1) + dt.timedelta(i) for i in range(420)]
    bars = spark.createDataFrame([(d, "AAPL", 50.0) for d in days], "date date, ticker string, close double")
    rows = [("AAPL", D(2021, 2, 15), k, v) for k, v in (("revenue", 1000.0), ("shares", 10.0), ("equity", 500.0), ("net_income", 100.0))]
    rows.append(("AAPL", D(2022, 2, 15), "revenue", 1200.0))
    got = fund.fundamental_ratios(bars, spark.createDataFrame(rows, "ticker string, filed date, concept string, value double"))
    pick = lambda d: got.where(F.col("date") == d).first()
    assert pick(D(2021, 2, 14)).sales_to_price is None
    assert pick(D(2021, 2, 15)).sales_to_price == pytest.approx(2.0)
    assert pick(D(2022, 2, 14)).rev_growth_yoy is None
    assert pick(D(2022, 2, 15)).rev_growth_yoy == pytest.approx(0.2)


def test_insider_flow_counts_from_its_day_and_roll_forward(spark):
    days = [d.date() for d in pd.bdate_range("2021-06-01", periods=40)]
    bars = spark.createDataFrame([(d, "A") for d in days], "date date, ticker string")
    tx = spark.createDataFrame([("A", D(2021, 6, 15), 500.0, 1), ("A", D(2021, 6, 19), 100.0, 1)],
                               "ticker string, filed date, signed_value double, is_purchase int")  # the 19th is a Saturday
    plain = {r.date: r.insider_buy_count_90d for r in fund.insider_features(bars, tx).collect()}
    assert plain[D(2021, 6, 14)] == 0 and plain[D(2021, 6, 15)] == 1 and plain[days[-1]] == 1
    moved = {r.date: r.insider_buy_count_90d for r in fund.insider_features(bars, tx, bars.select("date").distinct()).collect()}
    assert moved[D(2021, 6, 18)] == 1 and moved[D(2021, 6, 21)] == 2


def test_submission_join_keeps_open_market_trades_of_the_universe(spark):
    sub = spark.createDataFrame([("1", "15-FEB-2021", " aapl "), ("2", "2021-03-01", "ZZZ")], fil.SUBMISSION)
    nd = spark.createDataFrame([("1", "P", "500", "100"), ("1", "S", "100", "100"), ("1", "A", "5", "1"), ("2", "P", "1", "1")], fil.NONDERIV)
    got = joins.submission_join(sub, nd, spark.createDataFrame([("AAPL",)], ["ticker"])).orderBy("signed_value").collect()
    assert [(r.filed, r.signed_value, r.is_purchase) for r in got] == [(D(2021, 2, 15), -10000.0, 0), (D(2021, 2, 15), 50000.0, 1)]


def test_fact_priority_unit_and_latest_period(spark):
    rows = [("A", "second", "USD", D(2020, 1, 1), 9.0, "FY", D(2020, 2, 1)), ("A", "first", "EUR", D(2020, 1, 1), 1.0, "FY", D(2020, 2, 1)),
            ("A", "first", "USD", D(2019, 1, 1), 2.0, "FY", D(2020, 2, 1)), ("A", "first", "USD", D(2020, 1, 1), 3.0, "FY", D(2020, 2, 1))]
    facts = spark.createDataFrame(rows, "ticker string, concept string, unit string, `end` date, val double, fp string, filed date")
    got = fund.pit_dedupe(facts, [("q", "first"), ("q", "second")]).collect()
    assert [(r.quantity, r.value) for r in got] == [("q", 3.0)]


def test_align_fills_gaps_from_the_first_bar(spark):
    rows = [(D(2020, 1, 1), "A", 1.0), (D(2020, 1, 4), "A", 4.0), (D(2020, 1, 2), "B", 2.0)]
    bars = spark.createDataFrame(rows, "date date, ticker string, close double")
    cal = b.calendar(spark.createDataFrame([(D(2020, 1, i),) for i in range(1, 6)], "date date"))
    got = {(r.ticker, r.date.day): r.close for r in b.align_bars(bars, cal).collect()}
    assert got == {("A", 1): 1, ("A", 2): 1, ("A", 3): 1, ("A", 4): 4, ("A", 5): 4, ("B", 2): 2, ("B", 3): 2, ("B", 4): 2, ("B", 5): 2}


def test_folds_are_disjoint_and_a_leak_is_reported(spark):
    rng = np.random.default_rng(0)
    days = pd.bdate_range("2020-01-01", periods=400)
    pdf = pd.DataFrame([(d.date(), i, t, *rng.normal(size=3)) for i, d in enumerate(days) for t in "ABCDE"],
                       columns=["date", "pos", "ticker", "f1", "f2", "target"])
    panel = spark.createDataFrame(pdf).withColumn("leaky", F.col("target") * 1.0)
    folds = splits.walk_forward_folds(b.calendar(panel), 4, 100, 40, 2, 5)
    assert folds.count() == 4
    assert splits.leakage_audit(panel, folds, ["f1", "f2"], 5).isEmpty()
    issues = splits.leakage_audit(panel, folds, ["f1", "leaky"], 5).collect()
    assert [(r.kind, r.subject) for r in issues] == [("feature_is_target", "leaky")]
    stats = splits.fold_stats(panel, folds, 5).orderBy("fold").collect()
    assert all(r.train_to < r.test_from and r.n_test == 200 for r in stats)
    # walk-forward ridge and elastic net against the plain formulas on the same rows
    coefs = linear.fit_folds(panel, ["f1", "f2"], folds, 5, {"ridge": ("ridge", ["f1", "f2"]), "net": ("elasticnet", ["f1", "f2"])}).collect()
    f0 = folds.where("fold = 0").first()
    tr = pdf[pdf.pos < linear.train_end(f0, 5)]
    x = ((tr[["f1", "f2"]] - tr[["f1", "f2"]].mean()) / tr[["f1", "f2"]].std(ddof=0)).to_numpy()
    y = (tr.target - tr.target.mean()).to_numpy()
    want = np.linalg.solve(x.T @ x + 10 * np.eye(2), x.T @ y)
    got = [r.std_coef for r in coefs if r.model == "ridge" and r.fold == 0]
    np.testing.assert_allclose(got, want, rtol=1e-8)
    w = np.array([r.std_coef for r in coefs if r.model == "net" and r.fold == 0])
    grad = x.T @ (y - x @ w) / len(y) - 0.0005 * w  # optimality of the elastic net
    for g, v in zip(grad, w):
        assert (abs(g - 0.0005 * np.sign(v)) < 1e-9) if v else abs(g) <= 0.0005 + 1e-12


def test_planted_signal_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", periods=300)
    rows = []
    for i, d in enumerate(days):
        s, noise = rng.normal(size=20), rng.normal(size=20)
        rows += [(d.date(), f"T{k:02d}", float(s[k]), float(s[k] + 2 * noise[k]), float(noise[k])) for k in range(20)]
    df = spark.createDataFrame(rows, "date date, ticker string, score double, target double, other double")
    good = ev.ic_summary(ev.rank_ic_by_date(df)).first()
    bad = ev.ic_summary(ev.rank_ic_by_date(df.withColumn("target", F.hash("date", "ticker").cast("double")))).first()
    assert good.ic_mean > 0.3 and abs(bad.ic_mean) < 0.05


def test_panel_is_complete_and_families_select(spark, toy_bars):
    _, bars = toy_bars
    bench = bars.groupBy("date").agg(F.avg("close").alias("close"))
    panel, features = build_panel(bars, bench, PanelConfig(horizon=5))
    out = panel.toPandas()
    assert len(out) > 100 and len(features) == 40 and not out.isna().any().any()
    assert abs(out.groupby("date").target.mean()).max() < 1
    assert select_families(features, ["momentum"]) == [f"mom_{w}" for w in (5, 10, 20, 40, 60, 120)]
    live, _ = build_panel(bars, bench, PanelConfig(horizon=5, keep_unlabeled=True))
    assert live.agg(F.max("pos")).first()[0] == 419


def test_verdicts(spark):
    table = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "fold int, ic double")
    run = lambda a, c: ev.source_verdict(table(a), table(c)).first().verdict
    assert run([.01, .02, .01, .02, .01], [.03, .042, .031, .04, .032]) == "PASS"
    assert run([.03, .04, .03, .04, .03], [.01, .01, .01, .01, .01]) == "HURTS"
    assert run([.01, .02, .03, None], [.011, .019, .03, .5]) == "NO_EDGE"
    assert run([.01, .02], [.5, .5]) == "INSUFFICIENT_FOLDS"


def test_unavailable_source_raises(spark):
    assert registry.require_source("price_volume") == "live"
    with pytest.raises(NotImplementedError):
        registry.require_source("news_apis")
    assert registry.live_fraction(registry.source_registry(spark)).first()[0] == pytest.approx(0.35)


def test_roundtrip_with_comments(spark, tmp_path):
    (tmp_path / "m.csv").write_text("# comment\nticker,start,end\nA,2020-01-01,2020-06-30\nA,2021-01-01,\nB,2020-01-01,\n")
    m = fil.read_membership(spark, str(tmp_path / "m.csv"))
    days = spark.createDataFrame([(D(2020, 3, 1), "A"), (D(2020, 9, 1), "A"), (D(2022, 1, 1), "A"), (D(2019, 1, 1), "B")], "date date, ticker string")
    kept = {(r.date.year, r.date.month, r.ticker) for r in joins.interval_join(days, m).collect()}
    assert kept == {(2020, 3, "A"), (2022, 1, "A")}
    flags = {(r.date.year, r.date.month, r.ticker) for r in joins.with_membership(days, m).where("member").collect()}
    assert flags == kept
