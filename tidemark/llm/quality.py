"""A quality classifier by regularised quadratic discriminant analysis.

``features`` turns whole texts into a short vector of statistics of their bytes, words and lines, as logarithms and log-odds, which
are near to normal. ``fit`` sums, for each class, the vectors and their products over all labelled rows (sums, so no
sample is taken and nothing but a fixed number of doubles reaches the driver), shrinks each class's covariance first towards the one pooled
over the classes, then towards its own diagonal, and keeps a Cholesky factor of its inverse and its log determinant. ``score`` is the logistic function
of the difference of the two log densities (Mahalanobis distances under the factors, and the log determinants), held by a
temperature that the labelled rows set, plus the log odds of the classes.

Nothing but the text enters a score. Null and empty texts have the statistics of an empty text and get a score like any other.
Rows with a null label don't count; several labels of a row all do. Repeated texts get equal scores. With labels of fewer than
two classes no density can be compared; the score then is the (smoothed) share of label 1 for every text. Other columns are kept;
those named like an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ByteHasher, slices, text_buffer, word_spans

NAMES = ("bytes", "words", "mean_word", "spread_word", "letters", "upper", "marks", "symbols", "wide", "breaks", "distinct_words", "symbol_words", "short_words", "line_words", "distinct_lines", "symbols_a_word", "repeated_words")


def _class_of_byte() -> np.ndarray:
    """0 white space, 1 lower-case letter, 2 upper-case, 3 digit, 4 mark of plain prose, 5 other ASCII, 6 part of a wider character."""
    out = np.full(256, 5, np.int8)
    out[128:] = 6
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[ord("a") : ord("z") + 1] = 1
    out[ord("A") : ord("Z") + 1] = 2
    out[ord("0") : ord("9") + 1] = 3
    out[list(b".,;:!?'\"()-")] = 4
    return out


_CLASS = _class_of_byte()


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole - part + 0.5))


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray, hasher: ByteHasher) -> np.ndarray:
    """The statistics of each row: rows x len(NAMES)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    kind = _CLASS[data]

    def per_row(hit: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    low, up, mark, wide = (per_row(kind == k) for k in (1, 2, 4, 6))
    letters = low + up + wide
    breaks = per_row(data == 10)
    starts, ends, rows = word_spans(data, offsets)
    length = (ends - starts).astype(float)
    words = np.bincount(rows, minlength=n).astype(float)
    total = np.bincount(rows, length, n)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(rows, length**2, n) / np.maximum(words, 1) - mean**2, 0))
    hashes = hasher.spans(data, starts, ends)
    distinct = _distinct(rows, hashes, n).astype(float)
    again = np.bincount(rows[1:], (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]), n) if len(rows) else np.zeros(n)
    # numbers and addresses say nothing of quality, so symbols count in other words only
    odd, number = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (kind == 5, (kind == 3) | (data == ord("@"))))
    symbols = np.where(number[ends] > number[starts], 0, odd[ends] - odd[starts])
    symbol, odd_words = np.bincount(rows, symbols, n), np.bincount(rows, symbols > 0, n)
    short = np.bincount(rows, length <= 3, n)
    # lines, each with the row it lies in
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    begin = begin[begin < len(data)]
    finish = np.minimum(np.append(begin[1:], len(data)), len(data))
    line_row = np.searchsorted(offsets, begin, side="right") - 1
    lines = np.bincount(line_row, minlength=n).astype(float)
    distinct_lines = _distinct(line_row, hasher.spans(data, begin, finish), n).astype(float) if len(begin) else np.zeros(n)
    return np.stack(
        [
            np.log1p(sizes), np.log1p(words), np.log1p(mean), np.log1p(spread), _odds(letters, sizes), _odds(up, sizes), _odds(mark, sizes), _odds(symbol, sizes),
            _odds(wide, sizes), _odds(breaks, sizes), _odds(distinct, words), _odds(odd_words, words), _odds(short, words), np.log1p(words / np.maximum(lines, 1)), _odds(distinct_lines, lines), np.log1p(symbol / np.maximum(words, 1)), _odds(again, words),
        ],
        axis=1,
    )


def with_features(df: DataFrame, text: str = "text", out: str = "features", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``: array<double>."""
    rest = [c for c in df.columns if c != out and (keep_text or c != text)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.ArrayType(T.DoubleType(), False), False)])

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            for part in slices(batch, text):
                made = features(*text_buffer(part.column(text)), hasher)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), column], [*rest, out])

    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, text]))).mapInArrow(run, schema)


@dataclass(frozen=True)
class Discriminant:
    """Means and factors of the two classes. ``white[k]`` is the transposed inverse of the covariance's Cholesky factor."""

    means: np.ndarray
    white: np.ndarray
    log_det: np.ndarray
    bias: float
    scale: float

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        if not len(self.means):
            return np.zeros(len(x))
        logs = [-0.5 * (((x - m) @ w) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.means, self.white, self.log_det, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.gap(x) + self.bias, -60, 60)))


def fit(rows: DataFrame, pool: float = 0.8, diagonal: float = 0.2, features: str = "features", label: str = "label") -> Discriminant:
    """From labelled rows (features, label 0 or 1). ``pool`` and ``diagonal`` are the two shares of shrinkage."""
    rows = rows.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and x is not null")

    def sums(batches):
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").to_pylist())
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                if len(z):
                    now = found.setdefault(k, [0, 0.0, 0.0])
                    now[0] += len(z)
                    now[1] = now[1] + z.sum(0)
                    now[2] = now[2] + z.T @ z
        for k, (n, a, b) in found.items():
            flat = [float(n), *a.tolist(), *b.ravel().tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["y", "i", "v"])

    parts = rows.mapInArrow(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    by: dict[int, dict[int, float]] = {}
    for r in parts:
        by.setdefault(r["y"], {})[r["i"]] = r["v"]
    count = [by[k][0] if k in by else 0.0 for k in (0, 1)]
    if min(count) < 2:
        return Discriminant(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), float(np.log((count[1] + 0.5) / (count[0] + 0.5))), 1.0)
    means, covs = [], []
    for k in (0, 1):
        d = int(round((np.sqrt(4 * len(by[k]) - 3) - 1) / 2))
        flat = np.array([by[k][i] for i in range(len(by[k]))])
        m = flat[1 : d + 1] / count[k]
        means.append(m)
        covs.append(flat[d + 1 :].reshape(d, d) / count[k] - np.outer(m, m))
    pooled = sum(c * n for c, n in zip(covs, count, strict=True)) / sum(count)
    white, log_det = [], []
    for c in covs:
        c = (1 - pool) * c + pool * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        white.append(np.linalg.solve(factor, np.eye(len(c))).T)
        log_det.append(2 * np.log(np.diag(factor)).sum())
    raw = Discriminant(np.array(means), np.array(white), np.array(log_det), float(np.log(count[1] / count[0])), 1.0)
    return _tempered(rows, raw)


def _tempered(rows: DataFrame, raw: Discriminant) -> Discriminant:
    """Sets the temperature by the least log loss over a fixed grid, summed over all labelled rows."""
    grid = [2.0**-k for k in range(9)]

    def losses(batches):
        total, seen = np.zeros(len(grid)), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                x = np.array(batch.column("x").to_pylist())
                sign = 1 - 2.0 * batch.column("y").to_numpy(zero_copy_only=False)
                gap = raw.gap(x)
                total += [np.logaddexp(0, sign * (g * gap + raw.bias)).sum() for g in grid]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(total)], ["i", "v"])

    found = {r["i"]: r["v"] for r in rows.mapInArrow(losses, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return Discriminant(raw.means, raw.white, raw.log_det, raw.bias, grid[min(found, key=found.get)] if found else 1.0)


def with_scores(df: DataFrame, model: Discriminant, features: str = "features", out: str = "score", drop_features: bool = True) -> DataFrame:
    """``df`` (with features) with ``out``: double from 0 to 1, higher if label 1 is likelier."""
    rest = [c for c in df.columns if c != out and not (drop_features and c == features)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.DoubleType(), False)])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(features).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(model.score(x))], [*rest, out])

    return df.mapInArrow(run, schema)


#: Labelled rows that a fit needs at most, so that a join with them can be a broadcast (16 bytes a row).
MOST_LABELS = 1_000_000


def few_labels(labels: DataFrame, most: int = MOST_LABELS, doc_id: str = "doc_id") -> DataFrame:
    """About ``most`` of the labels at most, by a hash of the id; all of fewer."""
    share = min(1.0, most / max(1, labels.count()))
    return labels.filter(F.shiftrightunsigned(F.xxhash64(F.lit("label"), doc_id), 12) * F.lit(2.0**-52) < F.lit(share))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: a quarter by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
