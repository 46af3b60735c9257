"""Boosted trees of all symbols against a plain loop over each."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting


def drawn(number, salt, share):
    return ((number * 7919 + salt * 104729 + 12289) % 2147483647 * 48271 % 2147483647) % 1000 < round(share * 1000)


def half_up(x):
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def plain_bins(rows, n_features, bins):
    """Bins of one symbol's rows."""
    out = [[] for _ in rows]
    for f in range(n_features):
        values = [r[1][f] for r in rows]
        low, high = min(values), max(values)
        cells = [min(int((v - low) / (high - low) * boosting.CELLS), boosting.CELLS - 1) if high > low else 0 for v in values]
        order = sorted(cells)
        before = {c: order.index(c) for c in set(cells)}
        for place, c in enumerate(cells):
            out[place].append(int(before[c] * bins / len(rows)))
    return out


def grow(rows, n_features, rounds, depth, rate, least, penalty, rows_share, features_share, seed):
    """Rows (day, bins, y) of one symbol: cuts by (round, node), and predictions."""
    p = [half_up(sum(y for *_, y in rows) / len(rows))] * len(rows)
    trees = {}
    for k in range(1, rounds + 1):
        node, leaf = [1] * len(rows), [0] * len(rows)
        for d in range(depth):
            for at in sorted({n for n in node if n >= 2**d}):
                mine = [i for i in range(len(rows)) if node[i] == at]
                used = [i for i in mine if drawn(rows[i][0], seed + k, rows_share)]
                if not used:
                    continue
                part = lambda s, n: float(s) * float(s) / (n + penalty)
                s, n, best = sum(rows[i][2] - p[i] for i in used), len(used), None
                for f in range(n_features):
                    if not drawn(f, seed + 31 * k + 7, features_share):
                        continue
                    sl = nl = 0
                    for b in sorted({rows[i][1][f] for i in used}):
                        here = [i for i in used if rows[i][1][f] == b]
                        sl, nl = sl + sum(rows[i][2] - p[i] for i in here), nl + len(here)
                        if nl < least or n - nl < least or not n - nl:
                            continue
                        gain = part(sl, nl) + part(s - sl, n - nl) - part(s, n)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, f, b, half_up(sl * rate / (nl + penalty)), half_up((s - sl) * rate / (n - nl + penalty))
                if at == 1:
                    leaf = [half_up(s * rate / (n + penalty))] * len(rows)
                    trees[k, 1] = (None, None, None, None)
                if best:
                    trees[k, at] = best[1:]
                    for i in mine:
                        left = rows[i][1][best[1]] <= best[2]
                        node[i], leaf[i] = 2 * at + (not left), best[3] if left else best[4]
        p = [a + b for a, b in zip(p, leaf, strict=True)]
    return trees, p


SETTINGS = {"rounds": 4, "depth": 3, "rate": 0.3, "least": 3, "penalty": 1.0, "rows_share": 0.8, "features_share": 0.7, "seed": 42}


@pytest.fixture(scope="module")
def table(spark):
    rng, rows = random.Random(2), []
    for symbol, n in (("A", 300), ("B", 150), ("tiny", 20), ("flat", 120)):
        for i in range(n):
            a, b, c = rng.gauss(0, 1), float(rng.randint(0, 3)), rng.random() ** 4
            y = 0.01 * (a > 0.3) - 0.02 * (b == 2) * (c > 0.1) + rng.gauss(0, 0.002)
            rows.append((symbol, i, a, 1.0 if symbol == "flat" else b, c, 0.5 if symbol == "flat" else y))
    rows += [("A", 900, None, 1.0, 1.0, 1.0), ("A", 901, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "symbol string, i int, a double, b double, c double, y double").withColumn("dt", F.date_add(F.lit("2000-01-01"), F.col("i")))
    return boosting.binned(df, ["a", "b", "c"], bins=16).cache(), rows


def test_bins_and_trees(spark, table):
    df, rows = table
    trees, fitted = boosting.fit_boosted(df, **SETTINGS)
    got = {(r["symbol"], r["number"], r["node"]): (r["feature"], r["bin"], r["lv"], r["rv"]) for r in trees.filter("number > 0").collect()}
    p = {(r["symbol"], r["day"]): (list(r["x"]), r["p"]) for r in fitted.collect()}
    assert {s for s, _ in p} == {"A", "B", "flat"}
    for symbol in ("A", "B", "flat"):
        mine = [(10957 + r[1], r[2:5], half_up(r[5] * boosting.UNIT)) for r in rows if r[0] == symbol and None not in r]
        bins = plain_bins(mine, 3, 16)
        plain, want = grow([(day, x, y) for (day, _, y), x in zip(mine, bins, strict=True)], 3, **SETTINGS)
        assert {k[1:]: v for k, v in got.items() if k[0] == symbol} == plain
        assert [p[symbol, day] for day, *_ in mine] == list(zip(bins, want, strict=True))
    # predictions of the ensemble as a table are those that it was fitted with
    again = {(r["symbol"], r["day"]): r["prediction"] for r in boosting.predict_boosted(df, trees, SETTINGS["depth"], together=4).collect()}
    assert again == {k: v[1] / boosting.UNIT for k, v in p.items()}


def test_a_run_goes_on(spark, table, tmp_path):
    df, _ = table
    whole = boosting.fit_boosted(df, **SETTINGS)[1].select("symbol", "day", "p").collect()
    boosting.fit_boosted(df, **{**SETTINGS, "rounds": 2}, folder=str(tmp_path / "m"))
    (tmp_path / "m" / "fitted" / "2" / "_SUCCESS").unlink()  # as if it had been broken off while the second round was written
    trees, fitted = boosting.fit_boosted(df, **SETTINGS, folder=str(tmp_path / "m"))
    assert sorted(fitted.select("symbol", "day", "p").collect()) == sorted(whole) and trees.agg(F.max("number")).first()[0] == 4


def test_no_rows(spark):
    df = spark.createDataFrame([], "symbol string, day long, x array<int>, y long")
    trees, fitted = boosting.fit_boosted(df, rounds=1, depth=2)
    assert trees.count() == 0 and fitted.count() == 0
