"""Orders of windows against plain ones, window by window."""

import math

import numpy as np
import pytest

from tidemark.functions import kernels
from tidemark.plans.formula import EPS


def series():
    """Ties, gaps, a flat stretch, and steps of many sizes."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=400), 1)
    x[[0, 50, 51, 200]] = np.nan
    x[300:340] = 2.5
    return x


def each(x, w):
    for i in range(len(x)):
        part = x[max(0, i - w + 1) : i + 1]
        yield part if len(part) == w and not np.isnan(part).any() else None


@pytest.mark.parametrize("w", [1, 2, 5, 63, 500])
def test_sorted_windows(w):
    x = series()
    found, rank = kernels.sorted_window(x, w, [0.0, 0.2, 0.5, 0.95, 1.0])
    for i, part in enumerate(each(x, w)):
        if part is None:
            assert np.isnan(rank[i]) and all(np.isnan(f[i]) for f in found.values())
            continue
        assert rank[i] == ((part < x[i]).sum() + ((part == x[i]).sum() + 1) / 2) / w
        for q, f in found.items():
            assert f[i] == pytest.approx(np.quantile(part, q), abs=1e-12)


@pytest.mark.parametrize("block", [64, 1_000_000])
def test_shapes_of_windows(monkeypatch, block):
    monkeypatch.setattr(kernels, "BLOCK", block)
    x, w, bins = series(), 20, 10
    got = {"entropy": kernels.entropy(x, w, bins), "hurst": kernels.hurst(x, w), "argmax": kernels.argmax(x, w), "argmin": kernels.argmin(x, w)}
    for i, part in enumerate(each(x, w)):
        if part is None:
            assert all(np.isnan(g[i]) for g in got.values())
            continue
        shares = np.histogram(part, bins if np.ptp(part) else [part[0], part[0] + 1])[0] / (w + EPS)
        # at a bin's edge the histogram may choose the other bin
        edges = (part - part.min()) / (np.ptp(part) or 1) * bins
        if np.abs(edges - np.round(edges))[(edges > 1e-9) & (edges < bins - 1e-9)].min(initial=1) > 1e-9:
            assert got["entropy"][i] == pytest.approx(-sum(p * math.log(p + EPS) for p in shares if p > 0), abs=1e-9)
        if np.ptp(part):
            runs = [sum(part[: k + 1]) - (k + 1) * part.mean() for k in range(w)]
            assert got["hurst"][i] == pytest.approx(math.log((max(runs) - min(runs)) / (part.std() + EPS) + EPS) / math.log(w + EPS), abs=1e-9)
        assert got["argmax"][i] == list(part).index(max(part)) and got["argmin"][i] == list(part).index(min(part))


def test_no_list_in_the_plan_of_any_column():
    from tidemark.functions.library import FORMULAS
    from tidemark.operators.features import BAR_COLUMNS, COARSE_COLUMNS
    from tidemark.plans.formula import Compiler

    levels = Compiler(FORMULAS, {*BAR_COLUMNS, *COARSE_COLUMNS, "rn"}).levels(list(FORMULAS))
    texts = [c.text["spark"] for level in levels for c in level if not c.kernel]
    assert texts and not any("collect_list" in t or "percentile(" in t for t in texts)


def test_short_and_empty_series():
    for x in (np.array([]), np.array([1.0]), np.full(3, np.nan)):
        for made in (kernels.entropy(x, 5, 4), kernels.hurst(x, 5), kernels.argmax(x, 5), kernels.sorted_window(x, 5, [0.5])[1]):
            assert len(made) == len(x) and np.isnan(made).all()
