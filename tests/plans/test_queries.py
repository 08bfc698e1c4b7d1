"""Every query of the library against its SQL in DuckDB, on the small shared tables."""

import os

import pytest

from loomlog.plans import queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("LOOMLOG_TEST_SF", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("events", "orders", "customer", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, tables, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), tables.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_committed_scan_prunes_columns(spark):
    if not os.path.isdir(SF):
        pytest.skip("no shared tables")
    plan = queries.QUERIES["high_watermark"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[-1]
