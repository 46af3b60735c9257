"""Running sums, run lengths and exponential means of series that are too long for one task.

A series is cut into blocks of rows by ranges of (symbol, dt), and each block is scanned by itself, as if the series began there. What a block does to what comes
before it is small: a sum adds a number, a run goes on if it holds from the block's first row, and a mean is a straight line of the mean at the block's first known value. These go
along the blocks of each symbol (one row a block), and each block's rows are then put right by what came before, in plain columns.

A missing value adds nothing to a sum, ends a run, and leaves a mean as it is, whose weight decays by the rows missed (as ``kernels.ema``); a mean is NULL before its first value. NaN counts as missing.
Rows without a symbol are one series, those without dt come first. Rows of one symbol and dt stay in one block, in any order. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.kernels import linear
from tidemark.sources.scratch import written


@dataclass(frozen=True)
class Scans:
    """What to scan, by name: ``sums`` of columns, lengths of ``runs`` of conditions, and exponential ``means`` of columns with their spans."""

    sums: dict[str, Column] = field(default_factory=dict)
    runs: dict[str, Column] = field(default_factory=dict)
    means: dict[str, tuple[Column, float]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [*self.sums, *self.runs, *self.means]

    def inputs(self) -> list[Column]:
        numbers = {**self.sums, **{k: v for k, (v, _) in self.means.items()}}
        return [*[F.nanvl(c.cast("double"), F.lit(None)).alias(f"in_{k}") for k, c in numbers.items()], *[F.coalesce(c, F.lit(False)).alias(f"in_{k}") for k, c in self.runs.items()]]


def scan(df: DataFrame, scans: Scans, block_rows: int = 1_000_000) -> DataFrame:
    """symbol, dt and the scanned columns, one row for each of ``df`` (symbol, dt, and what the columns of ``scans`` read, without frames over the series). A task holds about ``block_rows`` rows."""
    rows = written(df.select("symbol", "dt", *scans.inputs()), "series")
    blocks = max(1, math.ceil(rows.count() / block_rows))
    cut = written(rows.repartitionByRange(blocks, "symbol", "dt").withColumn("block", F.spark_partition_id()), "blocks")
    local = written(cut.groupBy("symbol", "block").applyInPandas(_local(scans), _local_schema(cut, scans)), "local")
    before = _before(local, scans).withColumnRenamed("symbol", "of_symbol").withColumnRenamed("block", "of_block")
    both = local.join(before, F.col("symbol").eqNullSafe(F.col("of_symbol")) & (F.col("block") == F.col("of_block")))
    out = {k: F.col(k) + F.col(f"before_{k}") for k in scans.sums}
    out |= {k: F.col(k) + F.when(F.col(k) == F.col("place") + 1, F.col(f"before_{k}")).otherwise(0) for k in scans.runs}
    # A mean that nothing came before is the block's own; one whose block has had no value yet is the one before.
    out |= {k: F.when(F.col(k).isNull(), F.col(f"before_{k}")).otherwise(F.col(k) + F.col(f"share_{k}") * F.coalesce(f"shift_{k}", F.lit(0.0))) for k in scans.means}
    return both.select("symbol", "dt", *[v.alias(k) for k, v in out.items()])


def _local_schema(cut: DataFrame, scans: Scans) -> str:
    kinds = dict(cut.dtypes)
    columns = [f"symbol {kinds['symbol']}", f"dt {kinds['dt']}", "block int", "place bigint"]
    columns += [f"`{k}` double" for k in scans.sums] + [f"`{k}` bigint" for k in scans.runs]
    return ", ".join(columns + [f"`{n}` double" for k in scans.means for n in (k, f"share_{k}", f"in_{k}")])


def _local(scans: Scans):
    sums, runs, spans = list(scans.sums), list(scans.runs), {k: s for k, (_, s) in scans.means.items()}

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dt", kind="stable", na_position="first", ignore_index=True)
        place = np.arange(len(part))
        made = {"symbol": part["symbol"], "dt": part["dt"], "block": part["block"], "place": place}
        for k in sums:
            made[k] = part[f"in_{k}"].fillna(0.0).cumsum()
        for k in runs:
            made[k] = place - np.maximum.accumulate(np.where(part[f"in_{k}"].to_numpy(bool), -1, place))
        for k, span in spans.items():
            x = part[f"in_{k}"].to_numpy(float)
            made[k], made[f"share_{k}"] = _mean(x, span)
            made[f"in_{k}"] = x
        # A missing number is NULL, not NaN.
        return pd.DataFrame(made).astype({n: "Float64" for k in spans for n in (k, f"share_{k}", f"in_{k}")})

    return block


def _mean(x: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Means begun at the first value, and the share that this value has in each."""
    out, share = np.full(len(x), np.nan), np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    if len(at):
        kept = _kept(np.diff(at), span)
        last = np.cumsum(~np.isnan(x[at[0] :])) - 1
        out[at[0] :] = np.concatenate([x[at[:1]], linear(kept, (1 - kept) * x[at[1:]], x[at[0]])])[last]
        share[at[0] :] = np.concatenate([[1.0], np.cumprod(kept)])[last]
    return out, share


def _kept(rows, span: float):
    """The weight of a mean that is so many rows old beside a new value."""
    a = 2.0 / (span + 1.0)
    old = (1.0 - a) ** rows
    return old / (old + a)


def _before(local: DataFrame, scans: Scans) -> DataFrame:
    """For each block what comes before it: ``before_`` for all scans, and ``shift_``, by how much the mean at a block's first value is off."""
    ends = [F.count("*").alias("n"), *[F.max_by(k, "place").alias(k) for k in scans.names()]]
    for k in scans.means:
        known = F.when(F.col(f"in_{k}").isNotNull(), F.col("place"))
        ends += [F.min(known).alias(f"first_{k}"), F.max(known).alias(f"last_{k}"), F.min_by(f"in_{k}", known).alias(f"in_{k}"), F.max_by(f"share_{k}", "place").alias(f"share_{k}")]
    summary = local.groupBy("symbol", "block").agg(*ends)
    sums, runs, spans = list(scans.sums), list(scans.runs), {k: s for k, (_, s) in scans.means.items()}

    def series(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", ignore_index=True)
        out = {"symbol": part["symbol"], "block": part["block"]}
        for k in sums:
            out[f"before_{k}"] = np.concatenate([[0.0], part[k].to_numpy()[:-1].cumsum()])
        for k in runs:
            before, found = 0, []
            for run, n in zip(part[k], part["n"], strict=True):
                found.append(before)
                before = before + n if run == n else run
            out[f"before_{k}"] = found
        for k, span in spans.items():
            mean, age, found, shifts = None, 0, [], []
            for n, first, last, value, end, share in part[["n", f"first_{k}", f"last_{k}", f"in_{k}", k, f"share_{k}"]].itertuples(index=False):
                found.append(mean)
                shift = None
                if pd.isna(first):
                    age += n
                else:
                    shift = None if mean is None else float(_kept(age + first, span) * (mean - value))
                    mean, age = end + share * (shift or 0.0), n - last
                shifts.append(shift)
            out[f"before_{k}"], out[f"shift_{k}"] = pd.array(found, "Float64"), pd.array(shifts, "Float64")
        return pd.DataFrame(out)

    kind = dict(local.dtypes)["symbol"]
    columns = [f"symbol {kind}", "block int", *[f"`before_{k}` double" for k in sums], *[f"`before_{k}` bigint" for k in runs], *[f"`{n}_{k}` double" for k in spans for n in ("before", "shift")]]
    return summary.groupBy("symbol").applyInPandas(series, ", ".join(columns))
