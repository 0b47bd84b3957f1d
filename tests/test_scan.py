"""Scans over blocks and folds with a constant state, against pandas and plain loops."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions.scan import carried, compose, ewm_scan, number_rows
from panelspark.operators import governance as gov


@pytest.fixture(scope="module")
def series(spark):
    """One series with most rows, a null key, short ones, long stretches without values, one without any."""
    rng = np.random.default_rng(4)
    frames = []
    for name, n in (("big", 5000), ("a", 3), (None, 700), ("b", 40), ("empty", 30)):
        x = rng.normal(0, 1, n).cumsum() + 100
        x[rng.random(n) < 0.2] = np.nan
        x[n // 4: n // 2] = np.nan
        x[:2] = np.nan
        frames.append(pd.DataFrame({"key": name, "at": range(n), "x": np.nan if name == "empty" else x}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf, "key string, at long, x double").withColumn("x", F.nanvl("x", F.lit(None))).repartition(8, "at")


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("alpha", [0.01, 0.6])
def test_means_cross_blocks(series, partitions, alpha):
    pdf, df = series
    got = ewm_scan(df, ["key"], ["at"], "x", alpha, "y", partitions).toPandas().sort_values(["key", "at"], ignore_index=True)
    want = pdf.assign(key=pdf.key.fillna("~"), y=0.0)
    want["y"] = want.groupby("key").x.transform(lambda v: v.ewm(alpha=alpha, adjust=False, ignore_na=True).mean())
    got = got.assign(key=got.key.fillna("~")).sort_values(["key", "at"], ignore_index=True)
    want = want.sort_values(["key", "at"], ignore_index=True)
    np.testing.assert_allclose(got.y.astype(float), want.y, rtol=1e-11)


@pytest.mark.parametrize("partitions", [1, 9])
def test_ordinals_cross_blocks(series, partitions):
    pdf, df = series
    got = number_rows(df, ["key"], ["at"], "n", partitions)
    assert got.columns == [*df.columns, "n"] and got.where("n <> at + 1").count() == 0 and got.count() == len(pdf)


def test_small_batches_keep_the_state(spark, series):
    pdf, df = series
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert number_rows(df, ["key"], ["at"], "n", 3).where("n <> at + 1").count() == 0
        got = {r.at: r.y for r in ewm_scan(df, ["key"], ["at"], "x", 0.1, "y", 3).where("key = 'b'").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = pdf[pdf.key == "b"].x.ewm(alpha=0.1, adjust=False, ignore_na=True).mean()
    assert [got[i] for i in range(2, 40)] == pytest.approx(want.tolist()[2:], rel=1e-12) and got[0] is None


def test_empty_table(series):
    _, df = series
    assert ewm_scan(df.limit(0), ["key"], ["at"], "x", 0.1, "y").count() == 0 and number_rows(df.limit(0), ["key"], ["at"], "n").count() == 0


def test_compose_is_the_loop():
    rng = np.random.default_rng(1)
    start = np.repeat([0, 3, 10], [3, 7, 90])
    a, b, first = rng.random(100), rng.random(100), rng.random(100)
    first[10:13] = np.nan
    got = compose(start, first, a, b)
    for s in (0, 3, 10):
        y, pa, pb = None, 1.0, 0.0
        for i in range(s, {0: 3, 3: 10, 10: 100}[s]):
            y = a[i] * y + b[i] if y is not None else (None if np.isnan(first[i]) else first[i])
            pa, pb = a[i] * pa, a[i] * pb + b[i]
            assert (np.isnan(got[0][i]) if y is None else got[0][i] == pytest.approx(y)) and got[1][i] == pytest.approx(pa) and got[2][i] == pytest.approx(pb)


def test_band_equals_the_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(s, int(k), n, float(rng.choice([0.02, 0.06, 0.1, 0.3]))) for s in ("p", "q") for k in range(2 if s == "q" else 0, 25) for n in "xyz" if rng.random() < 0.6]
    rows += [("q", 2, "w", None)]
    last, want = max(r[1] for r in rows), set()
    for s in ("p", "q"):
        first = min(r[1] for r in rows if r[0] == s)
        for n in "xyzw":
            mine = {r[1]: r[3] or 0.0 for r in rows if r[0] == s and r[2] == n}
            old = 0.0
            for k in range(first, last + 1):
                new = mine.get(k, 0.0)
                old = old if k != first and abs(new - old) < 0.05 else new
                if old and mine:
                    want.add((s, k, n, old))
    got = gov.no_trade_band(spark.createDataFrame(rows, "strategy string, rebal_no int, ticker string, weight double"), 0.05)
    assert {tuple(r) for r in got.collect()} == want


def test_fold_closes_every_series(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7)], "k string, v long")

    def fold():
        seen = []
        return (lambda row: seen.append(row) or []), lambda: [(seen[0][0], sum(v for _, v in seen))]

    assert {tuple(r) for r in carried(df, ["k"], ["v"], fold, "k string, total long").collect()} == {("a", 3), ("b", 5), (None, 7)}


def test_long_series_match_the_sql(spark, tmp_path):
    """The closed form of the SQL has to start anew: one of 82,000 known values went to infinity."""
    import duckdb
    from panelspark.catalog import ORACLES, QUERIES
    duckdb.sql("""SELECT CASE WHEN i % 50 > 0 THEN 'A' WHEN i % 100 > 0 THEN 'B' END AS l_returnflag, i AS l_orderkey, 1 AS l_linenumber, i % 7 AS l_partkey,
        i % 5 AS l_suppkey, (1 + hash(i) % 50)::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice FROM range(250000) r(i)
        """).write_parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["ewm_sparse"](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        want = con.execute(ORACLES["ewm_sparse"]).df()
    order = ["ticker", "date"]
    got, want = (x.fillna({"ticker": "~"}).sort_values(order, ignore_index=True) for x in (got, want))
    assert want["mean"].between(1, 50).all()
    assert len(got) == 250_000 and got[order].equals(want[order])
    np.testing.assert_allclose(got["mean"], want["mean"], rtol=0, atol=1.1e-6)
