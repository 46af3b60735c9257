"""Whole families of indicators, row by row: each value from the rows before it by the textbook's definition, without the formula language."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_indicators import EPS, near, prices  # noqa: F401
from tidemark.functions.library import GROUPS
from tidemark.operators import features as feat

NAN = math.nan
FAMILIES = ("momentum", "volume", "volatility", "structure", "relative_strength", "liquidity")


@pytest.fixture(scope="module")
def made(spark, prices):  # noqa: F811
    names = [n for f in FAMILIES for n in GROUPS[f]] + ["ADX14", "PlusDI14", "MinusDI14", "Choppiness_Index", "TRIX", "BB_Percent", "VolZ", "BreakReliab", "ATR", "CandlePos", "IndexDD_60", "DownVol_20"]
    bars = spark.createDataFrame(prices[prices.symbol == "A"]).withColumn("dt", F.to_date("dt"))
    return feat.features(bars, list(dict.fromkeys(names))).toPandas().sort_values("dt").reset_index(drop=True)


@pytest.fixture(scope="module")
def bars(prices):  # noqa: F811
    own = prices[prices.symbol == "A"]
    return {c: own[c].to_numpy() for c in ("Open", "High", "Low", "Close", "Volume", "Market", "Sector")}


def last(x, i, w):
    """The w values up to row i; None if there aren't so many."""
    part = x[i - w + 1 : i + 1] if i >= w - 1 else None
    return None if part is None or np.isnan(part).any() else part


def each(n, f):
    """f(i) for each row; NaN where a window is missing."""
    out = []
    for i in range(n):
        try:
            out.append(f(i))
        except TypeError:  # a window that isn't there
            out.append(NAN)
    return np.array(out, float)


def ema(x, span):
    out, mean = [], NAN
    for v in x:
        mean = v if mean != mean else mean if v != v else mean + 2 / (span + 1) * (v - mean)
        out.append(mean)
    return np.array(out)


def change(x, k=1):
    return np.array([NAN if i < k else x[i] / x[i - k] - 1 for i in range(len(x))])


def step(x, k=1):
    return np.array([NAN if i < k else x[i] - x[i - k] for i in range(len(x))])


def test_momentum(made, bars):
    h, lo, c = bars["High"], bars["Low"], bars["Close"]
    n = len(c)
    macd = ema(c, 12) - ema(c, 26)
    near(made["MACD"], macd)
    near(made["MACD_Hist"], macd - ema(macd, 9))
    near(made["PPO"], 100 * macd / (ema(c, 26) + EPS))
    near(made["ROC10"], 100 * change(c, 10))
    near(made["ROC20"], 100 * change(c, 20))
    place = each(n, lambda i: 100 * (c[i] - min(last(lo, i, 14))) / (max(last(h, i, 14)) - min(last(lo, i, 14)) + EPS))
    near(made["Stoch_K"], place)
    near(made["Stoch_D"], each(n, lambda i: sum(last(place, i, 3)) / 3))
    near(made["WilliamsR"], each(n, lambda i: -100 * (max(last(h, i, 14)) - c[i]) / (max(last(h, i, 14)) - min(last(lo, i, 14)) + EPS)))
    pressure = np.array([c[i] - (min(lo[i], c[i - 1]) if i else lo[i]) for i in range(n)])
    reach = np.array([(max(h[i], c[i - 1]) if i else h[i]) - (min(lo[i], c[i - 1]) if i else lo[i]) for i in range(n)])
    part = lambda i, w: sum(last(pressure, i, w)) / (sum(last(reach, i, w)) + EPS)
    near(made["Ultimate_Oscillator"], each(n, lambda i: 100 * (4 * part(i, 7) + 2 * part(i, 14) + part(i, 28)) / 7))
    x = each(n, lambda i: min(0.999, max(-0.999, 2 * ((c[i] - min(last(lo, i, 10))) / (max(last(h, i, 10)) - min(last(lo, i, 10)) + EPS) - 0.5))))
    near(made["Fisher_Transform"], each(n, lambda i: 0.5 * math.log((1 + x[i]) / (1 - x[i] + EPS)) if x[i] == x[i] else None))
    near(made["TRIX"], 100 * change(ema(ema(ema(c, 15), 15), 15)))


def test_directional_movement(made, bars):
    h, lo, c = bars["High"], bars["Low"], bars["Close"]
    n = len(c)
    tr = np.array([max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])) if i else h[i] - lo[i] for i in range(n)])
    up = np.array([max(0.0, h[i] - h[i - 1]) if i and h[i] - h[i - 1] > lo[i - 1] - lo[i] else 0.0 for i in range(n)])
    down = np.array([max(0.0, lo[i - 1] - lo[i]) if i and lo[i - 1] - lo[i] > h[i] - h[i - 1] else 0.0 for i in range(n)])
    plus, minus = (each(n, lambda i, d=d: 100 * sum(last(d, i, 14)) / (sum(last(tr, i, 14)) + EPS)) for d in (up, down))
    near(made["PlusDI14"], plus)
    near(made["MinusDI14"], minus)
    dx = 100 * abs(plus - minus) / (plus + minus + EPS)
    near(made["ADX14"], each(n, lambda i: sum(last(dx, i, 14)) / 14))
    near(made["Choppiness_Index"], each(n, lambda i: 100 * math.log(sum(last(tr, i, 14)) / (max(last(h, i, 14)) - min(last(lo, i, 14)) + EPS)) / math.log(14)))


def test_volume(made, bars):
    h, lo, c, v = (bars[x] for x in ("High", "Low", "Close", "Volume"))
    n = len(c)
    obv, pvt = [], []
    for i in range(n):
        obv.append((obv[-1] if i else 0.0) + (np.sign(c[i] - c[i - 1]) * v[i] if i else 0.0))
        pvt.append((pvt[-1] if i else 0.0) + ((c[i] / c[i - 1] - 1) * v[i] if i else 0.0))
    near(made["OBV"], obv)
    near(made["PVT"], pvt)
    obv = np.array(obv)
    near(made["OBV_Slope"], each(n, lambda i: np.polyfit(range(10), last(obv, i, 10), 1)[0]), 1e-6)
    flow = np.array([((c[i] - lo[i]) - (h[i] - c[i])) / (h[i] - lo[i] + EPS) * v[i] for i in range(n)])
    near(made["CMF20"], each(n, lambda i: sum(last(flow, i, 20)) / (sum(last(v, i, 20)) + EPS)))
    price = (h + lo + c) / 3
    rise = np.array([price[i] * v[i] if i and price[i] > price[i - 1] else 0.0 for i in range(n)])
    fall = np.array([price[i] * v[i] if i and price[i] < price[i - 1] else 0.0 for i in range(n)])
    near(made["MFI14"], each(n, lambda i: 100 - 100 / (1 + sum(last(rise, i, 14)) / (sum(last(fall, i, 14)) + EPS))))
    vwap = np.cumsum(price * v) / (np.cumsum(v) + EPS)
    near(made["VWAP"], vwap)
    near(made["VWAP_Distance"], (c - vwap) / (vwap + EPS))
    signed = np.array([v[i] if i and c[i] >= c[i - 1] else -v[i] for i in range(n)])
    near(made["Volume_Delta"], signed)
    near(made["UpDown_Volume_Ratio"], each(n, lambda i: sum(x for x in last(signed, i, 20) if x > 0) / (sum(-x for k, x in zip(range(i - 19, i + 1), last(signed, i, 20), strict=True) if x < 0 and k) + EPS)))


def test_volatility(made, bars):
    o, h, lo, c, v = (bars[x] for x in ("Open", "High", "Low", "Close", "Volume"))
    n = len(c)
    r = np.append(NAN, np.diff(np.log(c)))
    dev = lambda x: np.std(x, ddof=1)
    near(made["Historical_Volatility_20"], each(n, lambda i: dev(last(r, i, 20)) * math.sqrt(252) if last(r, i, 20) is not None else None))
    near(made["Historical_Volatility_60"], each(n, lambda i: dev(last(r, i, 60)) * math.sqrt(252) if last(r, i, 60) is not None else None))
    near(made["BB_Width"], each(n, lambda i: 4 * dev(last(c, i, 20)) / (sum(last(c, i, 20)) / 20 + EPS)), 1e-6)
    near(made["Donchian_High20"], each(n, lambda i: max(last(h, i, 20))))
    near(made["Donchian_Low20"], each(n, lambda i: min(last(lo, i, 20))))
    near(made["Donchian_Pos"], each(n, lambda i: (c[i] - min(last(lo, i, 20))) / (max(last(h, i, 20)) - min(last(lo, i, 20)) + EPS)))
    span, body = np.log(h / (lo + EPS)), np.log(c / (o + EPS))
    near(made["Parkinson_Volatility"], each(n, lambda i: math.sqrt(sum(last(span, i, 20) ** 2) / 20 / (4 * math.log(2)))))
    near(made["Garman_Klass_Volatility"], each(n, lambda i: math.sqrt(max(0.0, sum(0.5 * last(span, i, 20) ** 2 - (2 * math.log(2) - 1) * last(body, i, 20) ** 2) / 20))), 1e-6)
    fall = each(n, lambda i: (c[i] - max(last(c, i, 20))) / (max(last(c, i, 20)) + EPS))
    near(made["Ulcer_Index"], each(n, lambda i: math.sqrt(sum(last(fall, i, 20) ** 2) / 20)))
    near(made["VolZ"], each(n, lambda i: (v[i] - sum(last(v, i, 20)) / 20) / (dev(last(v, i, 20)) + EPS)))
    near(made["IndexDD_60"], each(n, lambda i: (bars["Market"][i] - max(last(bars["Market"], i, 60))) / (max(last(bars["Market"], i, 60)) + EPS)))


def test_structure_strength_and_liquidity(made, bars):
    h, lo, c, v, m, s = (bars[x] for x in ("High", "Low", "Close", "Volume", "Market", "Sector"))
    n = len(c)
    near(made["Distance_From_20D_High"], each(n, lambda i: c[i] / (max(last(h, i, 20)) + EPS) - max(last(h, i, 20)) / (max(last(h, i, 20)) + EPS)))
    near(made["Distance_From_52W_Low"], each(n, lambda i: (c[i] - min(last(lo, i, 252))) / (min(last(lo, i, 252)) + EPS)))
    near(made["RS_Nifty_20D"], change(c, 20) - change(m, 20))
    near(made["RS_Sector_5D"], change(c, 5) - change(s, 5))
    a, b = change(c), change(m)
    near(made["Rolling_Alpha_20"], each(n, lambda i: sum(last(a, i, 20)) / 20 - sum(last(b, i, 20)) / 20))
    near(made["Rolling_Correlation_Nifty_60"], each(n, lambda i: np.corrcoef(last(a, i, 60), last(b, i, 60))[0, 1] if last(a, i, 60) is not None else None))
    near(made["Information_Ratio_60"], each(n, lambda i: sum(last(a - b, i, 60)) / 60 / (np.std(last(a - b, i, 60), ddof=1) + EPS) if last(a, i, 60) is not None else None))
    run, runs = 0, []
    for x in change(c, 5) - change(m, 5):
        run = run + 1 if x > 0 else 0
        runs.append(run)
    near(made["RS_Persistence_5"], runs)
    near(made["Dollar_Volume"], c * v)
    near(made["Amihud_Illiquidity"], abs(np.append(NAN, np.diff(np.log(c)))) / (c * v + EPS))
    near(made["Volume_Dryup_Ratio"], each(n, lambda i: sum(last(v, i, 5)) / 5 / (sum(last(v, i, 20)) / 20 + EPS)))
    near(made["Liquidity_Shock"], each(n, lambda i: (c[i] * v[i] - np.mean(last(c * v, i, 20))) / (np.std(last(c * v, i, 20), ddof=1) + EPS) if i >= 19 else None))
    near(made["Spread_Proxy"], (h - lo) / (c + EPS))
    near(made["CandlePos"], (c - lo) / (h - lo + EPS))
