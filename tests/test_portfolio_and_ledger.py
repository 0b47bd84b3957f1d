import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.operators import governance as gov
from panelspark.operators import monitor as mon
from panelspark.operators import portfolio as pf
from panelspark.sources import ledger as led
from panelspark.streaming import ledger_streams as ls

D0 = dt.date(2024, 1, 1)
day = lambda i: D0 + dt.timedelta(i)


def path(spark, xs, key="s"):
    return spark.createDataFrame([(key, day(i), x) for i, x in enumerate(xs)], "strategy string, date date, ret double")


def test_governor_kills_reenters_cools_down_and_freezes(spark):
    run = lambda xs: [r.exposure for r in gov.governor(path(spark, xs)).orderBy("date").collect()]
    killed = run([-0.01] * 30 + [0.02] * 30)
    assert killed[29] == 0.0 and killed[-1] == 1.0
    stop = run([-0.05] + [0.0] * 7)
    assert stop == [1.0] + [0.0] * 5 + [1.0, 1.0]
    assert run([-0.001] * 3 + [0.0])[3] == 0.0
    today = gov.governor_today(path(spark, [0.01, None, -0.05])).first()
    assert (today.exposure, today.reason) == (0.0, "cooldown")


def reference_governor(xs):
    nav = peak = 1.0
    consec = cool = 0
    killed = False
    out = []
    for r in xs:
        out.append(0.0 if killed or cool > 0 else 1.0)
        nav *= 1 + r
        peak = max(peak, nav)
        dd = nav / peak - 1
        if dd <= -0.2:
            killed = True
        elif killed and dd >= -0.1:
            killed = False
        if r <= -0.04:
            cool = 5
        elif cool > 0:
            cool -= 1
        consec = consec + 1 if r < 0 else 0
        if consec >= 3:
            cool = max(cool, 5)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-0.15, 0.15), max_size=80))
def test_governor_state_equals_a_plain_loop(xs):
    cut = len(xs) // 3
    first, memory = gov.governor_path(np.array(xs[:cut]), gov.GovernorMemory())
    then, _ = gov.governor_path(np.array(xs[cut:]), memory)
    before = ["ok", *first, *then][:len(xs)]
    assert [float(s == "ok") for s in before] == reference_governor(xs)


def test_cap_moves_weight_and_stays_normalised(spark):
    rows = [("s", day(0), t, w) for t, w in zip("ABCDE", (10.0, 3.0, 2.0, 1.0, 0.0))]
    df = spark.createDataFrame(rows, "strategy string, date date, ticker string, weight double")
    got = [r.weight for r in pf.cap_and_normalize(df, 0.4).orderBy("ticker").collect()]
    w = np.array([10, 3, 2, 1, 0.0]) / 16
    for _ in range(10):
        over = w > 0.4
        if not over.any():
            break
        ex = (w[over] - 0.4).sum()
        w[over] = 0.4
        w[~over] += ex * w[~over] / w[~over].sum()
    np.testing.assert_allclose(got, w / w.sum(), rtol=1e-12)
    strict = pf.cap_and_normalize(df, 0.1, strict=True).agg(F.max("weight"), F.sum("weight")).first()
    assert strict[0] <= 0.1 and strict[1] < 0.6
    zero = pf.cap_and_normalize(df.withColumn("weight", F.lit(0.0)), 0.4)
    assert {round(r.weight, 6) for r in zero.collect()} == {0.2}


def test_band_keeps_small_changes(spark):
    rng = np.random.default_rng(2)
    w = np.where(rng.random((12, 4)) < 0.3, 0, rng.random((12, 4)))
    rows = [("s", i, f"T{k}", float(w[i, k])) for i in range(12) for k in range(4) if w[i, k] > 0]
    df = spark.createDataFrame(rows, "strategy string, rebal_no long, ticker string, weight double")
    got = {(r.rebal_no, r.ticker): r.weight for r in gov.no_trade_band(df, 0.3).collect()}
    held, want = w[0].copy(), {}
    for i in range(12):
        held = w[i].copy() if i == 0 else np.where(np.abs(w[i] - held) < 0.3, held, w[i])
        want.update({(i, f"T{k}"): v for k, v in enumerate(held) if v != 0})
    assert got == pytest.approx(want)


def test_overlays_scale_with_what_was_known(spark):
    days = 120
    book = spark.createDataFrame([("s", day(i), -0.02 if i % 4 else 0.01, 0.0, -0.02 if i % 4 else 0.01) for i in range(days)],
                                 "strategy string, date date, gross double, cost double, ret double")
    market = spark.createDataFrame([(day(i), float(i > 50), 0.2, 0.1) for i in range(days)], "date date, risk_on double, breadth200 double, market_vol double")
    got = gov.apply_overlays(book, market, [gov.Scenario("plain"), gov.Scenario("off", regime_off=0.2), gov.Scenario("gov", hard_risk=True)]).toPandas()
    plain, off, risk = (got[got.scenario == n].sort_values("date").reset_index(drop=True) for n in ("plain", "off", "gov"))
    assert (plain.exposure == 1).all() and off.gross[1] == pytest.approx(-0.004) and off.exposure[52] == 1 and off.exposure[51] == 0.2
    assert set(risk.exposure) == {0.0, 1.0} and risk.exposure.iloc[-1] == 0


def test_risk_contributions_are_equal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * [1, 2, 3, 1, 1]
    x[:, 4] = -0.8 * x[:, 0] + 0.3 * rng.normal(size=60)  # a hedge
    w, cov = pf._risk_parity_weights(x), np.cov(x, rowvar=False)
    np.testing.assert_allclose(w * (cov @ w), np.full(5, w @ cov @ w / 5), rtol=1e-6)
    assert w.sum() == pytest.approx(1) and (w > 0).all()


def test_cash_buffer_waits_or_times_out(spark):
    rows = [("a", day(i), 100.0 if i == 0 else 0.0, i == 3) for i in range(6)] + [("b", day(i), 50.0 if i == 0 else 0.0, False) for i in range(6)]
    got = gov.cash_buffer(spark.createDataFrame(rows, "account string, date date, deposit double, ev_ok boolean"), 4).orderBy("account", "date").collect()
    assert [r.released for r in got] == [0, 0, 0, 100, 0, 0] + [0, 0, 0, 0, 50, 0]


def test_combined_book_respects_classes_and_experiments(spark):
    targets = spark.createDataFrame([("s1", "A", 1.0), ("s2", "B", 1.0), ("s3", "C", 1.0), ("s4", "D", 1.0)], "sleeve string, ticker string, weight double").withColumn("date", F.lit(day(0)))
    sleeves = spark.createDataFrame([("s1", 1, "stocks", 1.0, "live", 0.3, "core"), ("s2", 2, "stocks", 1.0, "live", 0.4, "core"),
                                     ("s3", 3, "crypto", 1.0, "live", 0.9, "experimental"), ("s4", 4, "crypto", 1.0, "shadow", 0.9, "core")],
                                    "sleeve string, ord int, asset_class string, allocation double, status string, max_class_weight double, bucket string")
    got = {r.ticker: r.weight for r in pf.combine_sleeves(targets, sleeves).collect()}
    assert got == pytest.approx({"A": 0.3, "B": 0.1, "C": 0.05})


def ledger_df(spark, xs, sleeve="a"):
    dec = [("X", "BUY", 0.0, "LOW", 1.0, 0.05, "", ""), ("Y", "SELL", 0.0, "LOW", 1.0, 0.0, "", "")]
    return spark.createDataFrame([(day(i), sleeve, "shadow", 1, x, dec) for i, x in enumerate(xs)], led.LEDGER_SCHEMA)


def test_standings_and_append(spark, tmp_path):
    df = ledger_df(spark, [None, 0.01, -0.02])
    row = mon.standings(df).first()
    assert row.n_days == 2 and row.cum_return == pytest.approx(1.01 * 0.98 - 1) and row.last_exposure == pytest.approx(0.05)
    table = str(tmp_path / "ledger")
    led.append_ledger(df, table)
    led.append_ledger(led.append_if_newer(ledger_df(spark, [0.5, 0.5, 0.5, 0.03]), spark.read.parquet(table)), table)
    kept = spark.read.parquet(table).orderBy("date").collect()
    assert [r.day_return for r in kept] == [None, 0.01, -0.02, 0.03] and {r.n_positions for r in kept} == {1}


def test_drift_alarm_and_warm_up(spark):
    quiet, shift = ledger_df(spark, [0.001] * 60, "quiet"), ledger_df(spark, [0.001] * 60 + [-0.03] * 40, "shift")
    rep = {r.sleeve: r for r in mon.drift_report(quiet.union(shift).union(ledger_df(spark, [0.01] * 19, "young"))).collect()}
    assert not rep["quiet"].drift_flag and rep["shift"].drift_flag and rep["young"].note == "warming up (19/20 obs)"


def test_gap_return_ignores_unknown_assets(spark):
    prices = spark.createDataFrame([(D0, "AAA", 100.0), (dt.date(2024, 2, 1), "AAA", 110.0), (D0, "BBB", 50.0), (dt.date(2024, 2, 1), "BBB", 45.0)], "date date, ticker string, close double")
    t = spark.createDataFrame([("b", "AAA", 0.5, D0, dt.date(2024, 2, 3)), ("b", "BBB", 0.25, D0, dt.date(2024, 2, 3)), ("b", "ZZZ", 0.2, D0, dt.date(2024, 2, 3)), ("z", "AAA", 1.0, D0, D0)],
                              "sleeve string, ticker string, weight double, d0 date, d1 date")
    got = {r.sleeve: r.day_return for r in mon.realized_gap_return(t, prices).collect()}
    assert got == pytest.approx({"b": 0.5 * 0.1 - 0.25 * 0.1, "z": 0.0})


def test_streamed_governor_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    xs = rng.normal(-0.002, 0.03, 60)
    rows = ledger_df(spark, [float(x) for x in xs], "a").union(ledger_df(spark, [float(x) for x in -xs], "b"))
    folder = str(tmp_path / "in")
    for lo, hi in ((0, 17), (17, 40), (40, 60)):
        rows.where(F.col("date").between(day(lo), day(hi - 1))).coalesce(1).write.mode("append").json(folder)
    ls.use_rocksdb(spark)
    ls.run_available(ls.stream_governor(ls.ledger_stream(spark, folder, 1)), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("sleeve", "date").toPandas()
    batch = gov.governor(rows.select(F.col("sleeve").alias("strategy"), "date", F.col("day_return").alias("ret"))).orderBy("strategy", "date").toPandas()
    assert got.exposure.tolist() == batch.exposure.tolist() and got.reason.tolist() == batch.reason.tolist()
