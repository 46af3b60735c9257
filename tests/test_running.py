"""Streams of scans against the scan of the whole table, across restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.scans import scan
from tidemark.streaming.running import running
from tests.test_scans import SCHEMA, scans, table


def test_a_restarted_stream_gives_the_scan_of_all_rows(spark, tmp_path):
    rows = table()
    start = dt.date(2000, 1, 1)
    ends = [0, 1, 2, 45, 400, 1000]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in zip(ends, ends[1:], strict=False):
        part = [r for r in rows if a <= (r[1] - start).days < b]
        if a == 45:
            # Rows that were there before, and one without a day.
            part += [("A", start, 1e9, True, 0), ("A", None, 1e9, True, 0)]
        spark.createDataFrame(part[::-1], SCHEMA).write.mode("append").parquet(source)
        stream = running(spark.readStream.schema(SCHEMA).parquet(source), scans())
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out)
    late = got.filter("late").collect()
    assert len(late) == 2 and all(r[k] is None for r in late for k in ("total", "run", "short", "long"))
    want = {(r["symbol"], r["dt"]): r for r in scan(spark.createDataFrame(rows, SCHEMA), scans()).collect()}
    found = got.filter(~F.col("late")).collect()
    assert len(found) == len(want)
    for r in found:
        for k in ("total", "run", "short", "long"):
            w = want[r["symbol"], r["dt"]][k]
            assert (r[k] is None) if w is None else r[k] == pytest.approx(w, abs=1e-9), (r, k, w)
