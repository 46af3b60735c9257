"""Fits by group and the chain of training stages: one model for each bucket, tuned for each symbol by month, week and day, and predictions from the best.

A model is linear in its features with an intercept, one set of coefficients for each target. A fit needs the sums of products of a group's rows
only: they are aggregated in parts before their exchange, so a bucket with a third of all rows is no task of its own, and all groups
are fitted in one pass. A small solve for each group follows. Tuning draws the coefficients to those of the parent checkpoint with the
strength of ``penalty`` rows, where a first fit draws them to zero; a group of few rows thus stays near its parent.

Networks and boosted trees that are trained elsewhere come in by ``models.score_with``; the registry, the choice of checkpoints and the table of predictions are the same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import splits
from tidemark.operators.clean import in_stage
from tidemark.operators.joins import STAGES, best_checkpoint
from tidemark.operators.signals import prediction_table
from tidemark.sources.scratch import written

#: Targets of a model: the next row's return, its direction (1 or 0 beyond a quarter of the mean true range, else 0.5; smoothed), and how strong it is beside the training rows' returns.
TARGETS = ("ret", "dir", "int")
REGISTRY = ("symbol", "bucket", "stage", "cutoff", "path", "rows_used", *TARGETS)


def with_targets(rows: DataFrame, ret: str = "LogRet", kind: str = "pretrain") -> DataFrame:
    """``rows`` (symbol, dt, High, Low, Close and a return) with ``TARGETS`` and ``part`` of the row after each; NULL at the end of a series. ``part`` is train, val or neither (the embargo at the cut), as
    ``splits.holdout`` deals rows; the mean and spread that the third target is scaled by are those of each symbol's training rows."""
    made = splits.holdout(splits.with_direction(rows, ret), kind)
    whole = Window.partitionBy("symbol")
    known = F.when(F.col("part") == "train", F.col(ret))
    made = made.withColumn("_int", splits.intensity(F.col(ret), F.avg(known).over(whole), F.stddev_pop(known).over(whole) + 1e-9))
    after = {"ret": F.col(ret), "dir": F.when(F.col(ret).isNotNull(), splits.smooth(F.col("direction"))), "int": F.col("_int"), "part": F.col("part")}
    return made.withColumns({f"_{k}_after": F.lead(v).over(splits.series()) for k, v in after.items()}).select(*rows.columns, *[F.col(f"_{k}_after").alias(k) for k in after])


def _products(features: list[str], when: Column | None = None) -> list[Column]:
    """A group's number of rows, products of its features (with the intercept) and of these with the targets; of the rows ``when`` a condition holds. Rows with a NULL feature or target don't count."""
    z = [F.lit(1.0), *map(F.col, features)]
    part = F.lit(True) if when is None else when
    for c in (*features, *TARGETS):
        part = part & F.col(c).isNotNull()

    def total(x):
        return F.sum(F.when(part, x).otherwise(0.0))

    squares = F.array(*[total(z[i] * z[j]) for i in range(len(z)) for j in range(i + 1)])
    return [F.count_if(part).alias("rows_used"), squares.alias("_zz"), *[F.array(*[total(x * F.col(t)) for x in z]).alias(f"_{t}") for t in TARGETS]]


def _solved(sums: DataFrame, keys: list[str], d: int, prior: DataFrame | None, penalty: float) -> DataFrame:
    """Models of groups' sums: keys, rows_used and the coefficients. Groups without rows have none."""
    sums = sums.filter("rows_used > 0")
    none = F.array_repeat(F.lit(0.0), d)
    if prior is None:
        sums = sums.withColumns({f"_prior_{t}": none for t in TARGETS})
    else:
        sums = sums.join(prior.select(*keys, *[F.col(t).alias(f"_prior_{t}") for t in TARGETS]), keys, "left").withColumns({f"_prior_{t}": F.coalesce(f"_prior_{t}", none) for t in TARGETS})

    @F.pandas_udf("array<double>")
    def solve(zz: pd.Series, zt: pd.Series, before: pd.Series) -> pd.Series:
        made = [np.linalg.solve(_full(a, d) + penalty * np.eye(d), np.asarray(b) + penalty * np.asarray(p)) for a, b, p in zip(zz, zt, before, strict=True)]
        return pd.Series(made, dtype=object)

    return sums.select(*keys, "rows_used", *[solve("_zz", f"_{t}", f"_prior_{t}").alias(t) for t in TARGETS])


def _full(low: np.ndarray, d: int) -> np.ndarray:
    """A symmetric matrix of the rows of its lower half."""
    out = np.zeros((d, d))
    out[np.tril_indices(d)] = low
    return out + out.T - np.diag(np.diag(out))


def fit_groups(rows: DataFrame, keys: list[str], features: list[str], prior: DataFrame | None = None, penalty: float = 1.0) -> DataFrame:
    """A model for each group: keys, rows_used, and the coefficients of each target (intercept first) as array<double>. ``prior`` has keys and coefficients to be drawn to. Rows with a NULL feature or target don't count."""
    return _solved(rows.groupBy(*keys).agg(*_products(features)), keys, len(features) + 1, prior, penalty)


def train(rows: DataFrame, members: DataFrame, features: list[str], cutoff: str, penalty: float = 20.0) -> DataFrame:
    """All checkpoints up to ``cutoff`` as a registry (``REGISTRY``): the yearly one of each bucket of ``members`` (symbol, bucket), and those of each symbol by month, week and day, each
    tuned from the one before it that the symbol has. ``rows``: symbol, dt, the features and ``TARGETS``.

    The bars are gone through once: every stage's sums are parts of one aggregate by symbol, a bucket's are those of its symbols, and each stage's models are written before the next one starts from them."""
    names, d = list(reversed(STAGES)), len(features) + 1
    ends = {stage: in_stage(F.col("dt"), stage, cutoff) for stage in names}
    every = [F.struct(*_products(features, ends[stage])).alias(stage) for stage in names]
    sums = written(rows.groupBy("symbol").agg(*every).join(members.select("symbol", "bucket"), "symbol"), "sums")
    of_bucket = sums.select("bucket", f"{names[0]}.*")
    added = [F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c, n in (("_zz", d * (d + 1) // 2), *((f"_{t}", d) for t in TARGETS))]
    yearly = written(_solved(of_bucket.groupBy("bucket").agg(F.sum("rows_used").alias("rows_used"), *added), ["bucket"], d, None, penalty), names[0])
    out = [_checkpoints(yearly.withColumn("symbol", F.lit(None).cast("string")), names[0], cutoff)]
    parent = written(members.select("symbol", "bucket").join(yearly, "bucket").select("symbol", "bucket", *TARGETS), "parents")
    for stage in names[1:]:
        tuned = written(_solved(sums.select("symbol", "bucket", f"{stage}.*"), ["symbol", "bucket"], d, parent, penalty), stage)
        out.append(_checkpoints(tuned, stage, cutoff))
        newer = tuned.select("symbol", "bucket", *[F.col(t).alias(f"_{t}") for t in TARGETS])
        parent = written(parent.join(newer, ["symbol", "bucket"], "left").select("symbol", "bucket", *[F.coalesce(f"_{t}", t).alias(t) for t in TARGETS]), "parents")
    return reduce(DataFrame.unionByName, out)


def _checkpoints(fitted: DataFrame, stage: str, cutoff: str) -> DataFrame:
    path = F.concat_ws("/", F.lit(stage), F.coalesce("symbol", F.col("bucket").cast("string")), F.lit(cutoff))
    return fitted.select("symbol", "bucket", F.lit(stage).alias("stage"), F.lit(cutoff).cast("date").alias("cutoff"), path.alias("path"), "rows_used", *TARGETS)


def apply_models(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` (features and coefficients) with predicted_log_return, dir_prob in [0, 1] and intensity in [-1, 1]."""

    def value(target: str):
        return sum((F.col(target)[i + 1] * F.col(f) for i, f in enumerate(features)), F.col(target)[0])

    bounded = {"predicted_log_return": value("ret"), "dir_prob": F.least(F.greatest(value("dir"), F.lit(0.0)), F.lit(1.0)), "intensity": F.least(F.greatest(value("int"), F.lit(-1.0)), F.lit(1.0))}
    return rows.withColumns(bounded)


def predict_only(rows: DataFrame, members: DataFrame, registry: DataFrame, features: list[str], cutoff: str) -> DataFrame:
    """The table of predictions for the day after each symbol's last row up to ``cutoff``, by the best checkpoint of its symbol or bucket; nothing is trained. ``members``: symbol, bucket, sector, volatility_class."""
    known = rows.filter(F.col("dt") <= F.lit(cutoff).cast("date")).dropna(subset=features)
    last = known.groupBy("symbol").agg(F.max_by(F.struct("dt", F.col("Close").alias("last_close"), *features), "dt").alias("z"), F.min("dt").alias("window_start"), F.max("dt").alias("window_end"), F.count("*").alias("rows_used"))
    last = last.select("symbol", "z.*", "window_start", "window_end", "rows_used").join(members, "symbol")
    best = best_checkpoint(members.select("symbol", "bucket"), registry.filter(F.col("cutoff") <= F.lit(cutoff).cast("date")))
    models = best.join(registry.select("path", *TARGETS), "path").select("symbol", "stage", "path", *TARGETS)
    return prediction_table(apply_models(last.join(models, "symbol"), features).withColumnRenamed("bucket", "bucket_name"))
