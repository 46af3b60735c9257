"""Iterative fits of all groups at once under the training losses: spike-weighted squared error of the return, focal loss of the soft direction, Huber loss of the intensity.

A model is linear in its features with an intercept for each target; the direction's goes through a sigmoid. An epoch is one pass over the rows of groups that are still open: losses, gradients and curvatures are
summed by group in parts before their exchange, and a small solve for each group takes a Newton step (for Huber's loss a reweighted one). A group has a state of its own: its coefficients, the best ones on its held-out rows
(of the training rows where it has none), its rate, which is reduced when it stalls, and whether it is open. It closes when it has waited too long, when a step no longer moves it, or after the last
epoch, and isn't passed on. Each epoch's states are written, so that a lost executor costs no earlier epoch.

Coefficients are drawn to the prior's with the strength of ``penalty``: the objective of a target is its weight times the sum of its losses, plus penalty / 2 times the squared distance. Rows with a NULL feature or target, or in the embargo,
don't count; a group without training rows has no model.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.clean import stage_window
from tidemark.operators.joins import STAGES
from tidemark.operators.models import focal_soft, smooth_huber, spike_weighted
from tidemark.operators.training import TARGETS, with_targets
from tidemark.sources.scratch import written

#: Of each stage, fixed values: weights of the losses of ret, dir and int; epochs; epochs without a better loss before a group closes.
STAGE_FITS = {
    "yearly": ((0.20, 0.70, 0.10), 35, 15),
    "monthly": ((0.22, 0.65, 0.13), 25, 8),
    "weekly": ((0.25, 0.60, 0.15), 20, 8),
    "daily": ((0.30, 0.55, 0.15), 5, 3),
}
#: A rate is reduced by this factor after so many epochs without a better loss, down to the least.
SLOWER, AFTER, LEAST = 0.5, 5, 1e-5
DELTA, ALPHA = 0.05, 0.5


def _terms(target: str, y: Column, eta: Column) -> tuple[Column, Column, Column]:
    """A row's loss, its derivative by the linear predictor, and a curvature that is never negative."""
    if target == "ret":
        w = 2 * (1.5 + 3.5 * F.pow(F.abs(y), F.lit(1.5)))
        return spike_weighted(y, eta), w * (eta - y), w
    if target == "int":
        e = eta - y
        return smooth_huber(y, eta, DELTA), F.least(F.greatest(e / DELTA, F.lit(-1.0)), F.lit(1.0)), 1 / F.greatest(F.lit(DELTA), F.abs(e))
    p = 1 / (1 + F.exp(-eta))
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    t = y * p + (1 - y) * (1 - p)
    a = (2 * y - 1) * p * (1 - p)
    slope = ALPHA * (2 * (1 - t) * F.ln(t) - (1 - t) * (1 - t) / t)
    bend = ALPHA * (-2 * F.ln(t) + 4 * (1 - t) / t + (1 - t) * (1 - t) / (t * t))
    return focal_soft(y, p, ALPHA), slope * a, F.greatest(bend * a * a + slope * a * (1 - 2 * p), 0.05 * p * (1 - p))


_STATE = "rows_used long, n_val long, prior array<double>, w array<double>, best array<double>, best_loss double, rate double, waited int, stalled int, epoch int, open boolean"


def _epoch(examples: DataFrame, state: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Open states with the sums of their groups' rows."""
    joined = examples.join(state.select(*keys, "w"), keys)
    z = [F.lit(1.0) if i == 0 else F.col("z")[i - 1] for i in range(d)]
    terms = {t: _terms(t, F.col(t), sum((F.col("w")[k * d + i] * z[i] for i in range(1, d)), F.col("w")[k * d])) for k, t in enumerate(TARGETS)}
    joined = joined.select(*keys, "z", "train", *[v.alias(f"{n}_{t}") for t, of in terms.items() for n, v in zip("lgh", of, strict=True)])
    in_train = [F.when(F.col("train"), x).otherwise(0.0) for x in z]
    sums = []
    for t in TARGETS:
        sums.append(F.array(*[F.sum(x * F.col(f"g_{t}")) for x in in_train]).alias(f"g_{t}"))
        sums.append(F.array(*[F.sum(in_train[i] * z[j] * F.col(f"h_{t}")) for i in range(d) for j in range(i + 1)]).alias(f"h_{t}"))
        sums.append(F.array(F.sum(F.when(F.col("train"), F.col(f"l_{t}"))), F.sum(F.when(~F.col("train"), F.col(f"l_{t}")))).alias(f"l_{t}"))
    return state.join(joined.groupBy(*keys).agg(*sums), keys)


def _moved(names: list[str], d: int, weights, penalty: float, epochs: int, patience: int, tolerance: float):
    """States after an epoch, from theirs and the sums."""
    low = np.tril_indices(d)

    def step(row) -> dict:
        held = 1 if row.n_val else 0
        loss = sum(w * getattr(row, f"l_{t}")[held] / (row.n_val or row.rows_used) for w, t in zip(weights, TARGETS, strict=True))
        out = {n: getattr(row, n) for n in names}
        if np.isnan(row.best_loss) or loss < row.best_loss - 1e-12:
            out |= {"best": row.w, "best_loss": loss, "waited": 0, "stalled": 0}
        else:
            out |= {"waited": row.waited + 1, "stalled": row.stalled + 1}
        if out["stalled"] >= AFTER:
            out |= {"rate": max(row.rate * SLOWER, LEAST), "stalled": 0}
        w, prior, moves = np.array(row.w, float), np.asarray(row.prior, float), []
        for k, t in enumerate(TARGETS):
            part, full = slice(k * d, (k + 1) * d), np.zeros((d, d))
            full[low] = getattr(row, f"h_{t}")
            full = weights[k] * (full + full.T - np.diag(np.diag(full))) + penalty * np.eye(d)
            moves.append(out["rate"] * np.linalg.solve(full, weights[k] * np.asarray(getattr(row, f"g_{t}")) + penalty * (w[part] - prior[part])))
        move = np.concatenate(moves)
        done = out["waited"] >= patience or row.epoch >= epochs or np.abs(move).max() < tolerance
        return out | {"w": w if done else w - move, "epoch": row.epoch + (not done), "open": not done}

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([step(r) for r in batch.itertuples(index=False)], columns=names)

    return run


def fit_under_losses(
    rows: DataFrame, keys: list[str], features: list[str], weights: tuple[float, float, float], prior: DataFrame | None = None, penalty: float = 20.0, epochs: int = 35, patience: int = 15, tolerance: float = 1e-7
) -> DataFrame:
    """A model for each group of ``rows`` (keys, features, ``TARGETS`` and part: train or val): keys, rows_used, the coefficients of each target (intercept first), epochs and loss of the best ones. ``prior`` has keys and coefficients to start from and be drawn to."""
    d = len(features) + 1
    known = rows.filter(F.col("part").isin("train", "val")).dropna(subset=[*features, *TARGETS])
    examples = written(known.select(*keys, F.array(*[F.col(f).cast("double") for f in features]).alias("z"), *TARGETS, (F.col("part") == "train").alias("train")), "examples")
    groups = examples.groupBy(*keys).agg(F.count_if("train").alias("rows_used"), F.count_if(~F.col("train")).alias("n_val")).filter("rows_used > 0")
    start = F.array_repeat(F.lit(0.0), 3 * d)
    if prior is not None:
        groups = groups.join(prior.select(*keys, F.concat(*TARGETS).alias("prior")), keys, "left")
        start = F.coalesce("prior", start)
    first = {"prior": start, "w": start, "best": start, "best_loss": F.lit(float("nan")), "rate": F.lit(1.0), "waited": F.lit(0), "stalled": F.lit(0), "epoch": F.lit(0), "open": F.lit(True)}
    names = [*keys, *(x.split()[0] for x in _STATE.split(", "))]
    state = written(groups.select(*keys, "rows_used", "n_val", *[v.alias(n) for n, v in first.items()]), "state")
    schema = T.StructType([*(groups.schema[k] for k in keys), *T.StructType.fromDDL(_STATE)])
    closed = []
    while True:
        state = written(_epoch(examples, state, keys, d).mapInPandas(_moved(names, d, weights, penalty, epochs, patience, tolerance), schema), "state")
        closed.append(state.filter(~F.col("open")))
        state = state.filter("open")
        if state.isEmpty():
            break
    done = reduce(DataFrame.unionByName, closed)
    return done.select(*keys, "rows_used", *[F.slice("best", k * d + 1, d).alias(t) for k, t in enumerate(TARGETS)], F.col("epoch").alias("epochs"), F.col("best_loss").alias("loss"))


def train_under_losses(bars: DataFrame, members: DataFrame, features: list[str], cutoff: str, penalty: float = 20.0, tolerance: float = 1e-4) -> DataFrame:
    """Checkpoints of all stages up to ``cutoff``: of each bucket of ``members`` (symbol, bucket) for the yearly stage, of each symbol for the others, each from its parent. ``bars``: symbol, dt, High, Low, Close, LogRet and the features.
    Labels, their scale and the held-out rows are those of the rows that a stage sees. (symbol, bucket, stage, rows_used, ``TARGETS``, epochs, loss)"""
    names, out, parent = list(reversed(STAGES)), [], None
    for stage in names:
        weights, epochs, patience = STAGE_FITS[stage]
        shared = stage == names[0]
        made = with_targets(stage_window(bars, stage, cutoff), kind="pretrain" if shared else "finetune").join(members.select("symbol", "bucket"), "symbol")
        keys = ["bucket"] if shared else ["symbol", "bucket"]
        fitted = written(fit_under_losses(made, keys, features, weights, parent, penalty, epochs, patience, tolerance), stage)
        out.append((fitted.withColumn("symbol", F.lit(None).cast("string")) if shared else fitted).withColumn("stage", F.lit(stage)))
        if shared:
            parent = written(members.select("symbol", "bucket").join(fitted, "bucket").select("symbol", "bucket", *TARGETS), "parents")
        else:
            newer = fitted.select(*keys, *[F.col(t).alias(f"_{t}") for t in TARGETS])
            parent = written(parent.join(newer, keys, "left").select(*keys, *[F.coalesce(f"_{t}", t).alias(t) for t in TARGETS]), "parents")
    return reduce(DataFrame.unionByName, [x.select("symbol", "bucket", "stage", "rows_used", *TARGETS, "epochs", "loss") for x in out])
