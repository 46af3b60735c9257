"""Recursions, ranks and orders of windows, for the grouped kernel: arrays of a symbol's rows in order of time, NaN where a value is missing.

A window of w rows gives NaN unless it has w values. Quantiles and ranks of one input and width come from one sorted window that is carried along the series: a row costs a binary
search in and one out. Entropy, rescaled range and the place of an extreme are taken from views of the series in blocks, so that memory is bounded whatever its length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable

import numpy as np

from tidemark.plans.formula import EPS

#: Values that one block of windows holds, some 8 MB.
BLOCK = 1_000_000

Job = tuple[str, tuple[str, ...], tuple[float, ...]]


def run(jobs: list[Job], series: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The columns of ``jobs`` (kind, names of inputs, numbers), in their order."""
    shares: dict[tuple, list[float]] = {}
    bands: dict[tuple, tuple] = {}
    for kind, inputs, numbers in jobs:
        if kind in ("quant", "pctrank"):
            shares.setdefault((*inputs, int(numbers[-1])), []).extend(numbers[:-1])
    windows = {(name, w): sorted_window(series[name], w, qs) for (name, w), qs in shares.items()}
    out = []
    for kind, inputs, numbers in jobs:
        args = [series[i] for i in inputs]
        if kind == "quant":
            out.append(windows[inputs[0], int(numbers[1])][0][numbers[0]])
        elif kind == "pctrank":
            out.append(windows[inputs[0], int(numbers[0])][1])
        elif kind.startswith("supertrend"):
            if (inputs, numbers) not in bands:
                bands[inputs, numbers] = supertrend(*args, *numbers)
            out.append(bands[inputs, numbers][0 if kind.endswith("line") else 1])
        else:
            out.append(KINDS[kind](*args, *numbers))
    return out


def ema(x: np.ndarray, span: float) -> np.ndarray:
    """Exponential mean with weight 2 / (span + 1), begun at the first value. A gap keeps the last mean, whose weight then decays by the rows missed."""
    a = 2.0 / (span + 1.0)
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return out
    known = x[at].tolist()
    mean = known[0]
    made = [mean]
    # step by step, in the order of the definition: a closed form over blocks differs in the last bits, which shows where a mean lies on half of the last place kept
    for value, rows in zip(known[1:], np.diff(at).tolist(), strict=True):
        if rows == 1:
            mean = mean * (1.0 - a) + value * a
        else:
            old = (1.0 - a) ** rows
            mean = (old * mean + a * value) / (old + a)
        made.append(mean)
    out[at[0] :] = np.array(made)[np.cumsum(~np.isnan(x[at[0] :])) - 1]
    return out


def linear(b: np.ndarray, c: np.ndarray, start: float) -> np.ndarray:
    """y of y[i] = b[i] * y[i - 1] + c[i], in blocks: within one, y is the product of b times a running sum of c over it. A block ends before its product falls below 1/1000."""
    out = np.empty(len(b))
    begin = 0
    logs = np.cumsum(-np.log(b))
    while begin < len(b):
        end = max(begin + 1, int(np.searchsorted(logs, (logs[begin - 1] if begin else 0.0) + 6.9)))
        product = np.cumprod(b[begin:end])
        out[begin:end] = product * (start + np.cumsum(c[begin:end] / product))
        start = out[end - 1]
        begin = end
    return out


def rankpct(x: np.ndarray) -> np.ndarray:
    """Mean rank of each value among the known ones, as a share of their number."""
    out = np.full(len(x), np.nan)
    known = ~np.isnan(x)
    if known.any():
        _, place, ties = np.unique(x[known], return_inverse=True, return_counts=True)
        out[known] = (np.cumsum(ties) - (ties - 1) / 2)[place] / known.sum()
    return out


def kama(close: np.ndarray, smooth: np.ndarray) -> np.ndarray:
    """Adaptive mean: moves to the close by a share of its own each row; a row without one keeps the mean."""
    out = np.full(len(close), np.nan)
    mean = np.nan
    for i, (c, s) in enumerate(zip(close.tolist(), smooth.tolist(), strict=True)):
        mean = c if i == 0 else mean + s * (c - mean) if s == s else mean
        out[i] = mean
    return out


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, multiple: float) -> tuple[np.ndarray, np.ndarray]:
    """Line and side (1 above, -1 below). Bands at the middle price plus and minus ``multiple`` true ranges only tighten until a close passes them. They begin at the first row with a range."""
    n = len(close)
    line, side = np.full(n, np.nan), np.ones(n)
    upper = lower = np.nan
    way = 1.0
    for i in range(n):
        if atr[i] != atr[i]:
            continue
        middle = (high[i] + low[i]) / 2
        up, down = middle + multiple * atr[i], middle - multiple * atr[i]
        if upper != upper:
            upper, lower = up, down
        else:
            before = close[i - 1]
            new_upper = up if up < upper or before > upper else upper
            new_lower = down if down > lower or before < lower else lower
            way = 1.0 if close[i] > upper else -1.0 if close[i] < lower else way
            upper, lower = new_upper, new_lower
        side[i] = way
        line[i] = lower if way > 0 else upper
    return line, side


def sorted_window(x: np.ndarray, w: int, shares: Iterable[float] = ()) -> tuple[dict[float, np.ndarray], np.ndarray]:
    """Of each window: the quantiles at ``shares``, between two values in proportion, and the mean rank of its last value as a share of ``w``."""
    places = [(q, min(int((w - 1) * q), w - 2) if w > 1 else 0, (w - 1) * q) for q in dict.fromkeys(shares)]
    found = {q: np.full(len(x), np.nan) for q, _, _ in places}
    rank = np.full(len(x), np.nan)
    values, window = x.tolist(), []
    for i, v in enumerate(values):
        if i >= w and values[i - w] == values[i - w]:
            del window[bisect_left(window, values[i - w])]
        if v == v:
            insort(window, v)
        if len(window) == w:
            left = bisect_left(window, v)
            rank[i] = (left + (bisect_right(window, v, left) - left + 1) / 2) / w
            for q, at, place in places:
                low = window[at]
                found[q][i] = low + (window[min(at + 1, w - 1)] - low) * (place - at)
    return found, rank


def of_windows(x: np.ndarray, w: float, value: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``value`` of every whole window: it takes some of them as rows, oldest value first, and gives one number each."""
    w = int(w)
    out = np.full(len(x), np.nan)
    if len(x) < w:
        return out
    missing = np.concatenate([[0], np.cumsum(np.isnan(x))])
    whole = missing[w:] == missing[:-w]
    view, last = np.lib.stride_tricks.sliding_window_view(x, w), out[w - 1 :]
    step = max(1, BLOCK // w)
    for a in range(0, len(view), step):
        some = whole[a : a + step]
        last[a : a + step][some] = value(view[a : a + step][some])
    return out


def entropy(x: np.ndarray, w: float, bins: float) -> np.ndarray:
    """Entropy of a window's values in equal bins from its least to its greatest; of one value alone, that of one bin."""
    alone = -(w / (w + EPS)) * math.log(w / (w + EPS) + EPS)

    def value(part: np.ndarray) -> np.ndarray:
        low = part.min(1, keepdims=True)
        wide = part.max(1, keepdims=True) - low
        flat = wide[:, 0] == 0
        bin_of = np.minimum(np.floor((part - low) / np.where(wide == 0, 1, wide) * bins), bins - 1)
        total = np.zeros(len(part))
        for b in range(int(bins)):
            p = (bin_of == b).sum(1) / (w + EPS)
            total -= np.where(p > 0, p * np.log(p + EPS), 0)
        return np.where(flat, alone, total)

    return of_windows(x, w, value)


def hurst(x: np.ndarray, w: float) -> np.ndarray:
    """Logarithm of a window's rescaled range (the reach of its running sum about the mean, over its spread) to the base of its length."""

    def value(part: np.ndarray) -> np.ndarray:
        runs = np.cumsum(part - part.mean(1, keepdims=True), 1)
        return np.log((runs.max(1) - runs.min(1)) / (part.std(1) + EPS) + EPS) / math.log(w + EPS)

    return of_windows(x, w, value)


def argmax(x: np.ndarray, w: float) -> np.ndarray:
    """Rows from a window's start to the first of its greatest values."""
    return of_windows(x, w, lambda part: part.argmax(1))


def argmin(x: np.ndarray, w: float) -> np.ndarray:
    """Rows from a window's start to the first of its least values."""
    return of_windows(x, w, lambda part: part.argmin(1))


#: Kinds whose column comes from their own inputs alone.
KINDS: dict[str, Callable[..., np.ndarray]] = {"ema": ema, "kama": kama, "rankpct": rankpct, "entropy": entropy, "hurst": hurst, "argmax": argmax, "argmin": argmin}
