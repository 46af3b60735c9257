"""Scans in blocks against scans of whole series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.operators.scans import Scans, scan

SCHEMA = "symbol string, dt date, v double, up boolean, place int"


def scans():
    return Scans(sums={"total": F.col("v")}, runs={"run": F.col("up")}, means={"short": (F.col("v"), 3.0), "long": (F.col("v"), 40.0)})


def table():
    rng, out = np.random.default_rng(3), []
    for name, n, gaps in (("A", 900, 0.0), ("B", 150, 0.6), (None, 40, 0.2), ("D", 1, 0.0), ("E", 60, 1.0), ("F", 300, 0.97)):
        for i in range(n):
            v = None if rng.random() < gaps else float("nan") if rng.random() < 0.02 else float(rng.normal())
            up = None if rng.random() < 0.01 else bool(rng.random() < 0.97)
            out.append((name, dt.date(2000, 1, 1) + dt.timedelta(days=i), v, up, 5))
    return out


def plain(rows):
    out = {}
    for name in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        x = np.array([np.nan if r[2] is None else r[2] for r in part])
        short, long = kernels.ema(x, 3.0), kernels.ema(x, 40.0)
        run, total = 0, 0.0
        for r, v, a, b in zip(part, x, short, long, strict=True):
            run, total = run + 1 if r[3] else 0, total if np.isnan(v) else total + v
            out[name, r[1]] = (total, run, a, b)
    return out


@pytest.mark.parametrize("block_rows", [17, 200, 10**6])
def test_as_whole_series(spark, block_rows):
    rows = table()
    want = plain(rows)
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    got = scan(df, scans(), block_rows).collect()
    assert len(got) == len(want)
    for r in got:
        total, run, a, b = want[r["symbol"], r["dt"]]
        assert r["run"] == run and r["total"] == pytest.approx(total, abs=1e-9)
        for found, mean in ((r["short"], a), (r["long"], b)):
            assert found is None if np.isnan(mean) else found == pytest.approx(mean, abs=1e-9), r


def test_a_long_series_is_many_blocks_and_empty_tables(spark):
    df = spark.range(5000).select(F.lit("A").alias("symbol"), F.col("id").alias("dt"), F.lit(1.0).alias("v"), F.lit(True).alias("up"))
    end = scan(df, scans(), 250).orderBy(F.desc("dt")).first()
    assert (end["total"], end["run"], end["short"]) == (5000.0, 5000, 1.0)
    assert scan(df.filter("dt < 0"), scans()).count() == 0
