"""Tables that are swapped at once, and the stream of fetches that fills them."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from tidemark.sources import versions
from tidemark.sources.fetching import FetchReader, Fetches
from tidemark.streaming import incremental

SCHEMA = "k string, v int"


def put(spark, rows, path, **more):
    return versions.write(spark.createDataFrame(rows, SCHEMA), path, "k", **more)


def got(spark, path, *more):
    return sorted(map(tuple, versions.read(spark, path, SCHEMA, *more).collect()), key=str)


def test_partitions_are_replaced_and_nulls_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    assert got(spark, path) == []
    put(spark, [("a/b", 1), ("[x]", 2), (None, 3)], path)
    put(spark, [("a/b", 4), ("c d%", 5)], path)
    assert got(spark, path) == sorted([("a/b", 4), ("[x]", 2), (None, 3), ("c d%", 5)], key=str)
    assert got(spark, path, ["a/b", None, "unknown"]) == sorted([("a/b", 4), (None, 3)], key=str)
    put(spark, [], path)
    assert len(got(spark, path)) == 4
    put(spark, [], path, whole=True)
    assert got(spark, path) == []
    with pytest.raises(ValueError, match="tidemark_part"):
        versions.write(spark.createDataFrame([(1,)], "tidemark_part int"), path, "tidemark_part")


def test_a_failing_task_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, [("a", 1), ("b", 2)], path)
    bad = spark.range(0, 1000, 1, 8).select((F.col("id") % 2).cast("string").alias("k"), F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("int").alias("v"))
    with pytest.raises(PySparkException):
        versions.write(bad, path, "k", whole=True)
    assert got(spark, path) == [("a", 1), ("b", 2)]
    # a manifest whose writer stopped midway isn't the table, and its number isn't taken again
    with open(f"{path}/manifests/{2:012d}", "w") as f:
        f.write('{"parts": {"a"')
    assert got(spark, path) == [("a", 1), ("b", 2)]
    put(spark, [("a", 3)], path)
    assert got(spark, path) == [("a", 3), ("b", 2)] and versions.version(spark, path)["number"] == 3


def test_writes_again_conflicts_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    assert put(spark, [("a", 1)], path, token=("s", 0)) and not put(spark, [("a", 9)], path, token=("s", 0)) and put(spark, [("a", 2)], path, token=("s", 1))
    seen = versions.version(spark, path)
    put(spark, [("b", 3)], path)
    with pytest.raises(versions.Conflict):
        put(spark, [("a", 7)], path, seen=seen)
    old = versions.read(spark, path, SCHEMA, None, seen)
    assert sorted(map(tuple, old.collect())) == [("a", 2)] and got(spark, path) == [("a", 2), ("b", 3)]
    assert versions.vacuum(spark, path, keep=1) == 1 and got(spark, path) == [("a", 2), ("b", 3)]
    assert len(os.listdir(f"{path}/data")) == 2


def vendor(symbol, first, last, at):
    """A bar a day, and one of a day that wasn't asked for; writes down its calls. Symbol BAD fails while the file "broken" is there."""
    with open(f"{at}/calls", "a") as f:
        f.write(f"{symbol} {first} {last}\n")
    if symbol == "BAD" and os.path.exists(f"{at}/broken"):
        raise OSError("no answer")
    first, last = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    return [(first + dt.timedelta(days=i), 1.0, 2.0, 0.5, i, None) for i in range(-1, (last - first).days + 1)]


def test_fetches_go_on_where_they_were(spark, tmp_path):
    spark.dataSource.register(Fetches)
    at, target, state = (str(tmp_path / x) for x in ("at", "target", "state"))
    os.mkdir(at)
    schema = Fetches({}).schema().removesuffix(", error string")

    def go(symbols, end):
        stream = spark.readStream.format("fetches").options(symbols=symbols, start="2024-01-01", end=end, days=10, tasks=3, wait=0, fetch="tests.test_versions:vendor", at=at).load()
        incremental.take_up(stream.filter("error IS NULL").drop("error"), target, state).awaitTermination()

    def calls():
        with open(f"{at}/calls") as f:
            out = f.read().splitlines()
        os.remove(f"{at}/calls")
        return out

    go("a, b,A", "2024-01-25")
    assert sorted(calls()) == [f"{s} {d}" for s in "AB" for d in ("2024-01-01 2024-01-10", "2024-01-11 2024-01-20", "2024-01-21 2024-01-25")]
    open(f"{at}/broken", "w").close()
    with pytest.raises(StreamingQueryException):
        go("A,BAD", "2024-02-03")
    assert incremental.current(spark, target, schema).count() == 50
    calls()
    os.remove(f"{at}/broken")
    go("A,BAD", "2024-02-03")
    # the days before aren't asked for again
    assert min(c.split()[1] for c in calls() if c.startswith("A ")) == "2024-01-26"
    table = incremental.current(spark, target, schema)
    counts = {r["symbol"]: (r["n"], r["d"]) for r in table.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("dt").alias("d")).collect()}
    assert counts == {"A": (34, 34), "B": (25, 25), "BAD": (34, 34)}


def test_failures_as_rows(tmp_path):
    at = str(tmp_path)
    open(f"{at}/broken", "w").close()
    reader = FetchReader({"symbols": "BAD,A", "start": "2024-01-01", "end": "2024-01-03", "fetch": "tests.test_versions:vendor", "at": at, "failures": "rows", "tries": "2", "wait": "0"})
    rows = [r for p in reader.partitions({}, reader.latestOffset()) for r in reader.read(p)]
    assert [r[-1] for r in rows if r[0] == "BAD"] == ["OSError: no answer"] and len([r for r in rows if r[0] == "A"]) == 3
    assert FetchReader({"start": "2024-01-01"}).partitions({}, {}) == []
