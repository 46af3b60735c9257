"""Grouped fits under the training losses against a plain optimiser of each group."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import fits

SCHEMA = "g string, a double, b double, ret double, dir double, int double, part string"


def total(target, w, x, y, weight, penalty, prior):
    """The objective as the losses are told."""
    eta = x @ w
    if target == "ret":
        loss = (1.5 + 3.5 * np.abs(y) ** 1.5) * (y - eta) ** 2
    elif target == "int":
        e = np.abs(y - eta)
        loss = np.where(e < 0.05, 0.5 * e**2 / 0.05, e - 0.025)
    else:
        p = np.clip(1 / (1 + np.exp(-eta)), 1e-7, 1 - 1e-7)
        t = y * p + (1 - y) * (1 - p)
        loss = -0.5 * (1 - t) ** 2 * np.log(t)
    return weight * loss.sum() + penalty / 2 * ((w - prior) ** 2).sum()


def optimum(*of):
    """By steps along numeric slopes, each as long as still helps."""
    target, x, *rest = of
    w, rate = np.array(rest[-1], float), 1e-3
    now = total(target, w, x, *rest)
    for _ in range(20_000):
        slope = np.array([(total(target, w + h, x, *rest) - total(target, w - h, x, *rest)) / 2e-6 for h in 1e-6 * np.eye(len(w))])
        while rate > 1e-14 and (after := total(target, w - rate * slope, x, *rest)) > now - 0.3 * rate * (slope**2).sum():
            rate /= 2
        if rate <= 1e-14 or np.abs(slope).max() < 1e-7:
            break
        w, now, rate = w - rate * slope, after, rate * 1.5
    return w


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(4), []
    for g, n in (("A", 240), ("B", 60), ("C", 1)):
        for i in range(n):
            a, b, noise = map(float, rng.normal(size=3))
            r = 0.03 * a - 0.01 * b + noise * 0.02 + 0.3 * (i % 50 == 7)
            out.append((g, a, b, r, 0.995 if r > 0.01 else 0.005 if r < -0.01 else 0.5, float(np.tanh(20 * r)), "train"))
    return out


def test_as_a_plain_optimiser(spark, rows):
    weights, penalty = (0.2, 0.7, 0.1), 2.0
    more = [("A", None, 1.0, 1.0, 1.0, 1.0, "train"), ("A", 9.0, 9.0, 9.0, 0.5, 1.0, None), ("only held out", 1.0, 1.0, 0.1, 0.5, 0.1, "val")]
    prior = spark.createDataFrame([("B", [0.1, 0.0, 0.2], [0.0, 0.3, 0.0], [0.0, 0.0, 0.1])], "g string, ret array<double>, dir array<double>, int array<double>")
    got = {r["g"]: r for r in fits.fit_under_losses(spark.createDataFrame(rows + more, SCHEMA), ["g"], ["a", "b"], weights, prior, penalty, epochs=60, patience=60).collect()}
    assert set(got) == {"A", "B", "C"} and got["A"]["rows_used"] == 240
    for g in "ABC":
        mine = [r for r in rows if r[0] == g]
        x = np.array([(1.0, r[1], r[2]) for r in mine])
        for k, target in enumerate(("ret", "dir", "int")):
            start = {"ret": [0.1, 0.0, 0.2], "dir": [0.0, 0.3, 0.0], "int": [0.0, 0.0, 0.1]}[target] if g == "B" else [0.0] * 3
            y = np.array([r[3 + k] for r in mine])
            of = (target, x, y, weights[k], penalty, np.array(start))
            best, have = optimum(*of), np.array(got[g][target])
            assert np.allclose(have, best, atol=2e-4), (g, target)
            assert total(target, have, *of[1:]) <= total(target, best, *of[1:]) + 1e-8


def test_stops_on_held_out_rows(spark, rows):
    """Held-out rows that contradict the training rows: the first state is the best, and the group closes after ``patience`` epochs, before the others."""
    turned = [(g, a, b, -r, 1 - d, -i, "val") for g, a, b, r, d, i, _ in rows if g == "B"]
    alike = [(*r[:-1], "val") for r in rows if r[0] == "A"]
    got = {r["g"]: r for r in fits.fit_under_losses(spark.createDataFrame(rows + turned + alike, SCHEMA), ["g"], ["a", "b"], (0.2, 0.7, 0.1), epochs=30, patience=4, tolerance=0.0).collect()}
    assert got["B"]["epochs"] == 4 and all(c == 0 for t in ("ret", "dir", "int") for c in got["B"][t])
    assert got["A"]["epochs"] > 4 and any(c != 0 for c in got["A"]["dir"])


def test_stages(spark):
    rng = np.random.default_rng(5)
    first, rows = dt.date(2000, 1, 1), []
    for s in "AB":
        x = rng.normal(0, 0.02, 380)
        rows += [(s, first + dt.timedelta(days=i), 101.0, 99.0, 100.0, float(v)) for i, v in enumerate(x)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, High double, Low double, Close double, LogRet double")
    members = spark.createDataFrame([("A", "b"), ("B", "b")], "symbol string, bucket string")
    got = fits.train_under_losses(bars, members, ["LogRet"], "2000-12-31").collect()
    assert {(r["symbol"], r["stage"]) for r in got} == {(None, "yearly"), *((s, t) for s in "AB" for t in ("monthly", "weekly", "daily"))}
    assert all(0 < r["epochs"] <= fits.STAGE_FITS[r["stage"]][1] and np.isfinite(r["loss"]) for r in got)
