"""Queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import QUERIES, SQL

#: One of each kind; all are compared at the next size by the driver.
PICKED = [q for q in QUERIES if q in SQL and not q.startswith(("ind_", "family_"))] + ["ind_base", "ind_trend", "ind_statistics", "ind_risk", "ind_evidence_totals", "family_trend", "family_gap"]


def text(v):
    return "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)


def rows(frame):
    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_as_the_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["ranked_reports", "reports_round_trip"])
def test_returns_near_a_half_rank_as_in_the_sql(spark, tmp_path, name):
    """845 / 1e5 * 1e4 is just below 84.5, 1235 / 1e5 * 1e4 is 123.5; a half that is rounded the other way ties with the next customer and takes the rank. -1 gives a negative zero."""
    balances = [9595.0, 9596.0, 845.0, 846.0, 1245.0, 1246.0, 1235.0, 1236.0, -845.0, -846.0, -1.0, 1.0, 0.0]
    spark.createDataFrame(list(enumerate(balances, 1)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)).toPandas(), duck.sql(SQL[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
