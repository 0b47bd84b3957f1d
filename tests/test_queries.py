"""A sample of registered queries against their SQL on the smallest data (tools/check.py runs all)."""
import os
import shutil
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module
from check import compare, connect

SAMPLE = ["align_bars", "rsi", "cs_rank", "rank_ic_by_date", "asof_join", "interval_join", "fold_stats", "ic_by_year",
          "portfolio_returns", "standings", "decide", "classify_regime_6"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, folder, name):
    got = entry_module.queries()[name](spark, folder).toPandas()
    assert compare(got, connect(folder).execute(entry_module.oracle_sql()[name]).df()) == ""


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_works_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(entry_module.__file__)
    shutil.copytree(os.path.join(root, "panelspark"), tmp_path / "panelspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 200 and not any(k.startswith('op1_') for k in n) and 'pipeline' not in n and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_a_regime_that_is_never_on_does_not_pass_the_gate(spark, folder, tmp_path):
    """The curve is inverted on every day, so the macro regime has no deviation and no Sharpe ratio."""
    import duckdb
    for name in ("lineitem", "part"):
        os.symlink(f"{folder}/{name}.parquet", tmp_path / f"{name}.parquet")
    duckdb.sql(f"SELECT * REPLACE('O' AS o_orderstatus) FROM '{folder}/orders.parquet'").write_parquet(str(tmp_path / "orders.parquet"))
    got = entry_module.queries()["macro_gate"](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as con:
        for name in ("lineitem", "part", "orders"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        assert compare(got, con.execute(entry_module.oracle_sql()["macro_gate"]).df()) == ""
    assert got.macro_sharpe.isna().all() and got.passed.tolist() == [False]


def test_form4_documents_stay_small(spark):
    """A document is read by one task; all 600,000 rows gave one of 269 MB."""
    folder = "/root/testdata/sf0.1"
    df = entry_module.queries()["read_form4_xml"](spark, folder)
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles()]
    assert max(sizes) < 50e6 and sum(sizes) > 2e8
    kept = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_returnflag <> 'N'").count()
    assert sum(r.n for r in df.collect()) == kept


def test_form4_documents_of_a_large_table_take_little_disk(spark, tmp_path):
    """Plain text is 447 bytes a transaction, 25 times the table: 97 GB for 216 million of them."""
    small = "/root/testdata/sf0.1"
    os.mkdir(tmp_path / "lineitem.parquet")
    for k in range(2):
        os.symlink(f"{small}/lineitem.parquet", tmp_path / f"lineitem.parquet/part-{k}.parquet")
    df = entry_module.queries()["read_form4_xml"](spark, str(tmp_path))
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles()]
    assert len(sizes) >= 12 and sum(sizes) < 30 * 1_200_000
    got, once = df.toPandas().set_index("code"), connect(small).execute(entry_module.oracle_sql()["read_form4_xml"]).df().set_index("code")
    assert sorted(got.index) == ["P", "S"]
    for code in got.index:
        assert got.n[code] == 2 * once.n[code] and got.shares[code] == 2 * once.shares[code]
        assert got.signed_value[code] == pytest.approx(2 * once.signed_value[code], rel=1e-9)
