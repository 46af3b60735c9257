"""Walk-forward fits against a refit of each split from its own rows."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import walkforward as wf

PLAN = wf.Plan(train=30, purge=2, embargo=3, test=13, step=7)
SCHEMA = "symbol string, dt date, a double, b double, target double, known date, day int"
START = dt.date(2020, 1, 1)


def day(i):
    return START + dt.timedelta(days=int(i))


def table(n=120, seed=5):
    rng, out = np.random.default_rng(seed), []
    for name, share in (("AA", 1.0), ("BB", 0.3), ("CC", 0.02)):
        for i in range(n):
            for _ in range(3 if rng.random() < share * 0.2 else 1):
                if rng.random() < share:
                    a, b = rng.normal(size=2)
                    wait = int(rng.choice([1, 2, 5, 6, 20, 60], p=[0.6, 0.2, 0.05, 0.05, 0.05, 0.05]))
                    known = day(i + wait) if i + wait < n else None
                    out.append((name, day(i), float(a), float(b), float(0.3 * a - b + rng.normal()), known, 1))
    # One bar a day for all days, so that the calendar has no holes.
    return out + [("DD", day(i), None if i % 9 == 0 else 1.0, float("nan") if i % 11 == 0 else float("inf") if i % 13 == 0 else 2.0, 4.0, day(min(i + 1, n - 1)), 1) for i in range(n)] + [(None, day(3), 1.0, 1.0, 1.0, day(4), 1), ("AA", None, 1.0, 1.0, 1.0, day(4), 1)]


def plain(rows, plan, penalty, n):
    def number(d):
        return (d - START).days

    out, tests = {}, {}
    good = [r for r in rows if r[0] and r[1] and r[5] and all(v is not None and np.isfinite(v) for v in r[2:5])]
    k = 0
    while k * plan.step + plan.span <= n:
        start = k * plan.step
        first_test = start + plan.train + plan.purge + plan.embargo
        for name in {r[0] for r in good}:
            train = [r for r in good if r[0] == name and start <= number(r[1]) < start + plan.train and number(r[5]) < first_test]
            test = [r for r in good if r[0] == name and first_test <= number(r[1]) < first_test + plan.test]
            if not train:
                continue
            x, y = np.array([[1, r[2], r[3]] for r in train]), np.array([r[4] for r in train])
            beta = np.linalg.solve(x.T @ x + penalty * np.eye(3), x.T @ y)
            miss = np.array([[1, r[2], r[3]] for r in test]).reshape(-1, 3) @ beta - np.array([r[4] for r in test])
            out[name, k] = (len(train), len(test), beta, miss)
            tests[name, k] = sorted(abs(miss))
        k += 1
    return out, tests


@pytest.mark.parametrize("plan", [PLAN, wf.Plan(train=20, purge=0, embargo=0, test=10, step=10), wf.Plan(train=11, purge=1, embargo=0, test=5, step=1), wf.Plan(train=10, purge=3, embargo=1, test=8, step=50)])
def test_each_split_is_refitted(spark, plan):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    want, tests = plain(rows, plan, 0.5, 120)
    made = wf.fit(df, ["a", "b"], "target", "known", plan=plan, penalty=0.5)
    got = {(r["symbol"], r["split_id"]): r for r in made.collect()}
    assert set(got) == set(want) and len(got) > 3
    for key, (n, m, beta, miss) in want.items():
        r = got[key]
        assert (r["train_rows"], r["test_rows"]) == (n, m)
        np.testing.assert_allclose(r["coefficients"], beta, atol=1e-8)
        if m:
            assert r["rmse"] == pytest.approx(np.sqrt(np.mean(miss**2)), abs=1e-6) and r["bias"] == pytest.approx(miss.mean(), abs=1e-7)
        else:
            assert r["rmse"] is r["r2"] is r["bias"] is None
        if key[0] == "DD":
            assert r["r2"] is None
    single = {}
    for r in wf.predictions(df, made, ["a", "b"], "target", "known", plan=plan).collect():
        single.setdefault((r["symbol"], r["split_id"]), []).append(abs(r["predicted"] - r["actual"]))
    assert set(single) == {k for k, v in tests.items() if v}
    for key, found in single.items():
        np.testing.assert_allclose(sorted(found), tests[key], atol=1e-8)


def test_keys_of_any_name(spark):
    rows = [(r[0], "z", *r[1:]) for r in table() if r[0] == "AA"]
    df = spark.createDataFrame(rows, "x0 string, y string, dt date, a double, piece double, n double, known date, split_id int")
    got = wf.fit(df, ["a", "piece"], "n", "known", keys=("x0", "y"), plan=PLAN)
    assert got.columns[:3] == ["x0", "y", "split_id"] and got.count() == PLAN.splits(120)


def test_short_and_empty(spark):
    for rows in ([], [r for r in table(40) if r[0] == "DD"]):
        df = spark.createDataFrame(rows, SCHEMA)
        made = wf.fit(df, ["a", "b"], "target", "known", plan=PLAN)
        assert made.count() == 0 and wf.predictions(df, made, ["a", "b"], "target", "known", plan=PLAN).count() == 0
    with pytest.raises(ValueError, match="penalty"):
        wf.fit(df, ["a"], "target", "known", penalty=0.0)
