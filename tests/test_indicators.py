"""Indicators against plain loops over one symbol's rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.library import FORMULAS, GROUPS
from tidemark.operators import features as feat
from tidemark.plans.formula import Compiler

EPS = 1e-9


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(3)
    n = 330
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    spread = rng.uniform(0.5, 3, n)
    rows = pd.DataFrame({"symbol": "A", "dt": pd.bdate_range("2020-01-01", periods=n), "Open": close + rng.normal(0, 0.5, n), "High": close + spread, "Low": close - spread, "Close": close, "Volume": rng.integers(1, 1000, n).astype(float), "Market": 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), "Sector": 20 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))})
    rows.loc[40, ["High", "Low", "Open"]] = rows.loc[40, "Close"]
    other = rows.head(7).assign(symbol="B")
    flat = rows.head(80).assign(symbol="C", Open=5.0, High=5.0, Low=5.0, Close=5.0, Volume=0.0)
    return pd.concat([rows, other, flat], ignore_index=True)


@pytest.fixture(scope="module")
def made(spark, prices):
    names = ["RSI14", "MACD_Signal", "ADX14", "Aroon_Up", "Aroon_Down", "KAMA20", "Supertrend", "Supertrend_Direction", "Klinger", "HMA20", "NW20", "Connors_RSI", "Entropy_Return_20", "Hurst_Exponent_60", "Variance_Ratio_20", "Autocorr_Return_5_60", "Rolling_Skew_20", "Rolling_Kurtosis_20",
             "Price_Slope_20", "Rolling_Linear_Trend_R2_20", "Rolling_Quadratic_Curvature_20", "Volume_Percentile_60", "Robust_Return_Z20", "Consecutive_Up_Days", "Rolling_Beta_60", "Crash_Risk_Score", "RSI_Turning_Point", "RSI_MA_Cross_Up", "Ultimate_Oscillator", "Bullish_Evidence_Total", "Trend_Score", "TSI"]
    bars = spark.createDataFrame(prices).withColumn("dt", F.to_date("dt"))
    out = feat.features(bars, names).toPandas().sort_values(["symbol", "dt"])
    return {s: g.reset_index(drop=True) for s, g in out.groupby("symbol")}


def near(got, want, tol=1e-7):
    got, want = np.asarray(got, float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all(), np.flatnonzero(np.isnan(got) != np.isnan(want))[:5]
    ok = ~np.isnan(want)
    assert np.allclose(got[ok], want[ok], rtol=tol, atol=tol)


def a(prices, column):
    return prices.loc[prices.symbol == "A", column].to_numpy()


def loop_ema(x, span):
    out, m = [], math.nan
    for v in x:
        m = v if m != m else m if v != v else m + 2 / (span + 1) * (v - m)
        out.append(m)
    return np.array(out)


def rolling(x, w, f):
    return np.array([f(x[i - w + 1 : i + 1]) if i >= w - 1 and not np.isnan(x[i - w + 1 : i + 1]).any() else math.nan for i in range(len(x))])


def test_every_public_column_has_a_formula():
    assert len(FORMULAS) == sum(map(len, GROUPS.values()))
    base = {*feat.BAR_COLUMNS, *feat.COARSE_COLUMNS, "rn"}
    levels = Compiler(FORMULAS, base).levels(list(FORMULAS))
    assert {c.name for level in levels for c in level} >= set(FORMULAS)


def test_rsi_and_macd(made, prices):
    c = a(prices, "Close")
    d = np.concatenate([[math.nan], np.diff(c)])
    gain, loss = rolling(np.where(d > 0, d, np.where(np.isnan(d), d, 0)), 14, np.mean), rolling(np.where(d < 0, -d, np.where(np.isnan(d), d, 0)), 14, np.mean)
    near(made["A"]["RSI14"], 100 - 100 / (1 + gain / (loss + EPS)))
    near(made["A"]["MACD_Signal"], loop_ema(loop_ema(c, 12) - loop_ema(c, 26), 9))
    near(made["A"]["TSI"], 100 * loop_ema(loop_ema(d, 25), 13) / (loop_ema(loop_ema(abs(d), 25), 13) + EPS))
    assert made["B"]["RSI14"].isna().all() and len(made["B"]) == 7


def test_kama_and_supertrend(made, prices):
    c, h, lo = a(prices, "Close"), a(prices, "High"), a(prices, "Low")
    mean, want = c[0], []
    for i in range(len(c)):
        if i >= 10:
            er = abs(c[i] - c[i - 10]) / (abs(np.diff(c[i - 10 : i + 1])).sum() + EPS)
            mean += (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - mean)
        want.append(c[0] if i == 0 else mean)
    near(made["A"]["KAMA20"], want)
    tr = [h[0] - lo[0], *(max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) for i in range(1, len(c)))]
    line, side = kernels.supertrend(h, lo, c, rolling(np.array(tr), 10, np.mean), 3)
    near(made["A"]["Supertrend"], line)
    near(made["A"]["Supertrend_Direction"], side)
    assert set(side) == {1.0, -1.0} and np.isnan(line[:9]).all() and not np.isnan(line[9:]).any()
    for i in range(10, len(c)):
        assert (line[i] <= c[i]) if side[i] > 0 else (line[i] >= c[i])


def test_klinger(made, prices):
    h, lo, c, v = (a(prices, x) for x in ("High", "Low", "Close", "Volume"))
    hlc, dm = h + lo + c, h - lo
    trend = [-1 if i == 0 or not hlc[i] > hlc[i - 1] else 1 for i in range(len(c))]
    cm = [dm[0]]
    for i in range(1, len(c)):
        cm.append((cm[-1] if trend[i] == trend[i - 1] else dm[i - 1]) + dm[i])
    force = v * trend * abs(2 * (dm / (np.array(cm) + EPS) - 1)) * 100
    line = loop_ema(force, 34) - loop_ema(force, 55)
    near(made["A"]["Klinger"], line - loop_ema(line, 13), 1e-6)


def test_windows(made, prices):
    c, v, h, lo = (a(prices, x) for x in ("Close", "Volume", "High", "Low"))
    r = np.concatenate([[math.nan], np.diff(np.log(c))])
    s = pd.Series(r)
    near(made["A"]["Rolling_Skew_20"], s.rolling(20).skew(), 1e-6)
    near(made["A"]["Rolling_Kurtosis_20"], s.rolling(20).kurt(), 1e-6)
    near(made["A"]["Volume_Percentile_60"], pd.Series(v).rolling(60).apply(lambda x: x.rank(pct=True).iloc[-1], raw=False))
    near(made["A"]["Price_Slope_20"], rolling(c, 20, lambda x: np.polyfit(range(20), x, 1)[0]))
    near(made["A"]["Rolling_Quadratic_Curvature_20"], rolling(c, 20, lambda x: 2 * np.polyfit(range(20), x, 2)[0]))

    def r2(x):
        p = np.polyval(np.polyfit(range(len(x)), x, 1), range(len(x)))
        return 1 - ((x - p) ** 2).sum() / (((x - x.mean()) ** 2).sum() + EPS)

    near(made["A"]["Rolling_Linear_Trend_R2_20"], rolling(c, 20, r2))

    def entropy(x):
        p = np.histogram(x, 10)[0] / (len(x) + EPS)
        p = p[p > 0]
        return -(p * np.log(p + EPS)).sum()

    near(made["A"]["Entropy_Return_20"], rolling(r, 20, entropy))

    def hurst(x):
        z = np.cumsum(x - x.mean())
        return np.log((z.max() - z.min()) / (x.std() + EPS) + EPS) / np.log(60 + EPS)

    near(made["A"]["Hurst_Exponent_60"], rolling(r, 60, hurst))
    near(made["A"]["Variance_Ratio_20"], s.rolling(25).apply(lambda x: x.diff(5).var() / (5 * x.diff().var() + EPS), raw=False))
    near(made["A"]["Autocorr_Return_5_60"], s.rolling(60).apply(lambda x: x.autocorr(5), raw=False))
    near(made["A"]["Aroon_Up"], rolling(h, 26, lambda x: 100 * np.argmax(x) / 25))
    near(made["A"]["Aroon_Down"], rolling(lo, 26, lambda x: 100 * np.argmin(x) / 25))
    med = s.rolling(20).median()
    near(made["A"]["Robust_Return_Z20"], 0.6745 * (s - med) / ((s - med).abs().rolling(20).median() + EPS))
    m = pd.Series(a(prices, "Market")).pct_change()
    near(made["A"]["Rolling_Beta_60"], pd.Series(c).pct_change().rolling(60).cov(m) / (m.rolling(60).var() + EPS))


def test_streaks_and_flags(made, prices):
    c = a(prices, "Close")
    run, want, streak, streaks = 0, [], 0, []
    for i in range(len(c)):
        up, down = i > 0 and c[i] > c[i - 1], i > 0 and c[i] < c[i - 1]
        run = run + 1 if up else 0
        streak = max(1, streak + 1) if up else min(-1, streak - 1) if down else 0
        want.append(run)
        streaks.append(streak)
    near(made["A"]["Consecutive_Up_Days"], want)

    def rsi(x, w):
        d = pd.Series(x).diff()
        return 100 - 100 / (1 + d.clip(lower=0).rolling(w).mean() / (-d.clip(upper=0).rolling(w).mean() + EPS))

    rank = pd.Series(c).pct_change().rolling(100).apply(lambda x: 100 * x.rank(pct=True).iloc[-1], raw=False)
    near(made["A"]["Connors_RSI"], (rsi(c, 3) + rsi(streaks, 2) + rank) / 3, 1e-6)
    velocity = made["A"]["RSI14"].diff()
    near(made["A"]["RSI_Turning_Point"], (np.sign(velocity) != np.sign(velocity.shift(1))).astype(float))
    ma = made["A"]["RSI14"].rolling(14).mean()
    near(made["A"]["RSI_MA_Cross_Up"], ((made["A"]["RSI14"] > ma) & (made["A"]["RSI14"].shift(1) <= ma.shift(1))).astype(float))


def test_flat_and_short_series_have_defined_values(made):
    flat = made["C"]
    assert not np.isinf(flat.drop(columns=["symbol", "dt"]).to_numpy(float)).any()
    assert (flat["RSI14"].dropna() == 0).all() and (flat["Consecutive_Up_Days"] == 0).all()
    assert (flat["Rolling_Linear_Trend_R2_20"].dropna() == 1).all()
    assert made["B"]["Bullish_Evidence_Total"].notna().all() and made["B"]["Trend_Score"].between(-1, 1).all()


def test_state_probabilities(spark, prices):
    bars = spark.createDataFrame(prices[prices.symbol == "A"]).withColumn("dt", F.to_date("dt"))
    names = ["Ecosystem_State_Frequency", "P_Up_Given_Ecosystem_State", "Expected_Downside_Given_Ecosystem_State", "Prob_State_Continuation", "Prob_Breakout_Transition", "Prob_Volatility_Compression"]
    got = feat.state_probabilities(bars, names).toPandas().sort_values("dt").reset_index(drop=True)
    c = a(prices, "Close")
    state, ret = got["Ecosystem_State_ID"].astype(int).tolist(), np.append(np.diff(np.log(c)), math.nan)
    for i in range(len(c)):
        past = [ret[j] for j in range(i) if state[j] == state[i]]
        down = [x for x in past if x < -0.001]
        row = got.iloc[i]
        near(row["P_Up_Given_Ecosystem_State"], (sum(x > 0.001 for x in past) + 1) / (len(past) + 3))
        near(row["Ecosystem_State_Frequency"], len(past) / (i + EPS) if past else 0)
        near(row["Expected_Downside_Given_Ecosystem_State"], sum(down) / (len(down) + EPS))
        moves = [state[j + 1] for j in range(i - 1) if state[j] == state[i]]
        near(row["Prob_State_Continuation"], sum(x == state[i] for x in moves) / len(moves) if moves else 0.5)
        near(row["Prob_Breakout_Transition"], sum(x // 27 == 2 and x % 9 // 3 >= 1 for x in moves) / len(moves) if moves else 1 / 3)
        near(row["Prob_Volatility_Compression"], sum(x % 27 // 9 == 0 for x in moves) / len(moves) if moves else 0.5)


def test_ema_over_gaps():
    x = np.array([math.nan, 1.0, 2.0, math.nan, math.nan, 4.0, 3.0])
    near(kernels.ema(x, 3), pd.Series(x).ewm(span=3, adjust=False).mean())
