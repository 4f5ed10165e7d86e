"""The driver's contract: every query with SQL gives the SQL's rows; plans are what they should be; the rest stands alone."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from evlog import queries as engine

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, tmp_path, name):
    __spark_entry__.queries()[name](spark, sf).write.parquet(str(tmp_path / "out"))
    want = duck.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    got = duck.execute(f"SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')").fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    listed = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))
    assert listed(got) == listed(want)


def test_expression_texts_of_odd_customers(spark, tmp_path):
    """Balances that two-decimal ones of small tables don't have: negative zero, halves of large numbers, more digits than a double's text, nothing finite."""
    balances = [-0.0, 0.0, -0.04, -0.25, 0.25, 2.0**44 + 0.25, -(2.0**44) - 0.25, 2.0**47 + 0.25, 2.0**62, -1.2345678901234567e17, 123456789012345680000.0, 1.2345e25, 1e40, float("nan"), float("inf"), float("-inf"), None]
    segments = ["BUILDING", "", None, "\u3000a\u00a0", "\ta\n", "\u200ba ", "\U0001f44d\U0001f3fdEY"]
    rows = [(i, "c", 1, balances[i % len(balances)], segments[i % len(segments)]) for i in range(len(balances) * len(segments))]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.sql(__spark_entry__.oracle_sql()["expression_texts"])
    got = __spark_entry__.queries()["expression_texts"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and {r.fixed for r in got} >= {"0.0", "-0.0", "17592186044416.3", "nan", "-inf", None}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_works_without_the_training_text_operators(tmp_path):
    """As when the driver has deleted them."""
    code = "import sys; sys.modules['evlog.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') for n in q)"
    root = Path(__file__).parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    assert not any("evlog.llm" in (text := p.read_text()) or ".llm import" in text for p in (root / "evlog").rglob("*.py") if "llm" not in p.parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    page = plan(engine.global_read_page(spark, sf))
    assert "TakeOrderedAndProject" in page and "GreaterThanOrEqual(event_id,500)" in page
    total = plan(engine.agg_signed_total(spark, sf))
    assert "ReadSchema: struct<event_type:string,value:double>" in total and "partial_sum" in total
    for name in ("global_read_page", "stream_heads", "view_latest_by_user", "counter_with_reset", "append_batch_conflicts", "timeseries_daily"):
        assert "CartesianProduct" not in plan(engine.QUERIES[name](spark, sf)), name
    assert "Window" not in plan(engine.stream_heads(spark, sf))
    assert "Python" not in plan(engine.state_machine_fold(spark, sf))
