"""Walk-forward evaluation: linear models of all groups in all splits of a calendar, and their errors on the splits' test days, from one pass over the rows.

Splits overlap: a day is trained on by train / step of them. Rows aren't copied to splits. The calendar is cut at every place where a split's training
or test begins or ends; rows are summed once by group and piece (in parts before the exchange, so a group with a third of all rows is no task of its own), sums
run along the pieces, and what a split sees is a difference of two running sums. Fits and squared errors need no more than that; ``predictions``
deals the test rows themselves (each is in test / step splits) for measures that need the single rows.

A row's target is known on a later day. A row trains a split if its day is a training day and its target is known before the first test day. Rows whose target
takes longer than purge and embargo are dealt to the splits one by one; of all others the day decides.

Rows with a missing or infinite feature or target, or without a group or day, count nowhere; nor does a row whose target is known on no day of the calendar. A calendar
shorter than a split has no splits; a split in which a group has no training rows has no row in the result. Equal rows count each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.training import _full
from tidemark.sources.scratch import written

SOLVED = "coefficients array<double>, rmse double, r2 double, bias double"


@dataclass(frozen=True)
class Plan:
    """Lengths in days of the calendar; split k starts at day k * step."""

    train: int = 756
    purge: int = 20
    embargo: int = 20
    test: int = 252
    step: int = 126

    @property
    def gap(self) -> int:
        return self.purge + self.embargo

    @property
    def span(self) -> int:
        return self.train + self.gap + self.test

    def bounds(self) -> dict[str, int]:
        """Days after a split's start where its parts begin, and where they are over."""
        return {"train_from": 0, "train_to": self.train, "test_from": self.train + self.gap, "test_to": self.span}

    def splits(self, days: int) -> int:
        return max(0, (days - self.span) // self.step + 1)

    def residues(self) -> list[int]:
        return sorted({b % self.step for b in self.bounds().values()})

    def piece(self, day: Column) -> Column:
        """The piece of the calendar that a day is in; pieces begin where a part of a split may begin or end."""
        inside = sum((F.when(day % self.step >= r, 1).otherwise(0) for r in self.residues()), F.lit(0))
        return (F.floor(day / self.step) * len(self.residues()) + inside - 1).cast("long")

    def first_piece(self, bound: int) -> int:
        """The piece that begins at a bound of split 0; that of split k is k * len(residues) later."""
        return bound // self.step * len(self.residues()) + self.residues().index(bound % self.step)


def calendar(rows: DataFrame) -> DataFrame:
    """The days of ``rows`` (dt) numbered from 0 as ``day``, written. One row a day, so one task orders them."""
    days = rows.select("dt").filter("dt IS NOT NULL").distinct()
    return written(days.withColumn("day", F.row_number().over(Window.orderBy("dt")).cast("long") - 1), "calendar")


def _placed(rows: DataFrame, days: DataFrame, features: list[str], target: str, known: str, keys: list[str]) -> DataFrame:
    """Rows that count: the keys as key0 …, dt, ``day``, ``known_day``, the features as x1 … after an x0 of 1, and the target as y."""
    numbers = [F.col(c).cast("double") for c in (*features, target)]
    counts = F.lit(True)
    for c in keys:
        counts = counts & F.col(c).isNotNull()
    for c in numbers:
        counts = counts & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    names = [*[F.col(c).alias(f"key{i}") for i, c in enumerate(keys)], *[c.alias(f"x{i + 1}") for i, c in enumerate(numbers[:-1])]]
    made = rows.filter(counts).select("dt", F.col(known).alias("known"), F.lit(1.0).alias("x0"), *names, numbers[-1].alias("y"))
    return made.join(days, "dt").join(days.select(F.col("dt").alias("known"), F.col("day").alias("known_day")), "known")


def _splits_of(day: Column, begin: int, end: int, plan: Plan, count: int, least: Column | None = None) -> Column:
    """The splits (of ``count``, not before ``least``) that have a day from ``begin`` to before ``end`` days after their start, as an array."""
    first = F.greatest(F.floor((day - end) / plan.step) + 1, F.lit(0), least if least is not None else F.lit(0)).cast("long")
    last = F.least(F.floor((day - begin) / plan.step), F.lit(count - 1)).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def fit(rows: DataFrame, features: list[str], target: str, known: str, keys: tuple[str, ...] = ("symbol",), plan: Plan = Plan(), penalty: float = 1.0, days: DataFrame | None = None) -> DataFrame:
    """A linear model for each group and split: keys, split_id (from 0), train_rows, test_rows, ``coefficients`` (intercept first; drawn to zero with the strength of ``penalty`` rows, which must be above zero), and on the
    test rows the root mean square error ``rmse``, ``r2`` and the mean error ``bias`` (NULL without test rows; r2 also without spread).

    ``rows``: keys, dt, features, the target and the day ``known`` it is known on; other columns are left alone. ``days`` is a ``calendar``, by default that of the rows' dt."""
    if penalty <= 0:
        raise ValueError("the penalty must be above zero")
    days = calendar(rows) if days is None else days
    names, d, count = [f"key{i}" for i in range(len(keys))], len(features) + 1, plan.splits(days.count())
    x, y = [F.col(f"x{i}") for i in range(d)], F.col("y")
    sums = {"n": F.lit(1), **{f"zz{i}_{j}": x[i] * x[j] for i in range(d) for j in range(i + 1)}, **{f"zy{i}": x[i] * y for i in range(d)}, "yy": y * y}

    at = _placed(rows, days, features, target, known, list(keys)).withColumn("slow", F.col("known_day") - F.col("day") > plan.gap)
    soonest = F.floor((F.col("known_day") - plan.train - plan.gap) / plan.step) + 1
    one_by_one = F.when(F.col("slow"), _splits_of(F.col("day"), 0, plan.train, plan, count, soonest)).otherwise(F.array().cast("array<bigint>"))
    places = F.concat(
        F.array(F.struct(F.lit(None).cast("long").alias("split_id"), plan.piece(F.col("day")).alias("piece"))),
        F.transform(one_by_one, lambda k: F.struct(k.alias("split_id"), F.lit(None).cast("long").alias("piece"))),
    )
    dealt = at.withColumn("place", F.explode(places)).select("*", "place.*")
    in_piece = F.col("piece").isNotNull()
    trains, tests = ~(in_piece & F.col("slow")), in_piece
    totals = [F.sum(F.when(which, v).otherwise(F.lit(0))).alias(f"{part}_{c}") for part, which in (("train", trains), ("test", tests)) for c, v in sums.items()]
    summed = written(dealt.groupBy(*names, "split_id", "piece").agg(*totals), "pieces")

    columns = [f"{part}_{c}" for part in ("train", "test") for c in sums]
    seen = _differences(summed.filter("piece IS NOT NULL").drop("split_id"), names, columns, plan, count)
    both = seen.unionByName(summed.filter("piece IS NULL").drop("piece")).groupBy(*names, "split_id").agg(*[F.sum(c).alias(c) for c in columns]).filter("train_n > 0")
    return _solved(both, d, penalty).select(*[F.col(f"key{i}").alias(c) for i, c in enumerate(keys)], "split_id", F.col("train_n").alias("train_rows"), F.col("test_n").alias("test_rows"), "model.*")


def _differences(pieces: DataFrame, names: list[str], columns: list[str], plan: Plan, count: int) -> DataFrame:
    """What each split adds to and takes from its sums: the running sums where its parts are over, and, negative, those where they begin.

    A running sum holds from after its piece up to the group's next one, so each row names the bounds it answers by arithmetic; no join is needed. A group has a row for each piece at most."""
    order = Window.partitionBy(*names).orderBy("piece")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = pieces.select(*names, "piece", F.lead("piece").over(order).alias("next"), *[F.sum(c).over(so_far).alias(c) for c in columns])
    width, answers = len(plan.residues()), []
    for name, bound in plan.bounds().items():
        own, sign = plan.first_piece(bound), 1 if name.endswith("_to") else -1
        first = F.greatest(F.floor((F.col("piece") - own) / width) + 1, F.lit(0)).cast("long")
        last = F.least(F.coalesce(F.floor((F.col("next") - own) / width), F.lit(count - 1)), F.lit(count - 1)).cast("long")
        part = name.split("_")[0]
        signs = [F.lit(sign if part == which else 0).alias(which) for which in ("train", "test")]
        answers.append(F.when(first <= last, F.transform(F.sequence(first, last), _signed(signs))))
    none = F.array().cast("array<struct<split_id:bigint,train:int,test:int>>")
    out = running.withColumn("answer", F.explode(F.concat(*[F.coalesce(a, none) for a in answers])))
    return out.select(*names, "answer.split_id", *[(F.col(c) * F.col(f"answer.{c.split('_')[0]}")).alias(c) for c in columns])


def _signed(signs: list[Column]) -> Callable[[Column], Column]:
    return lambda k: F.struct(k.alias("split_id"), *signs)


def _solved(sums: DataFrame, d: int, penalty: float) -> DataFrame:
    @F.pandas_udf(SOLVED)
    def model(zz: pd.Series, zy: pd.Series, test_zz: pd.Series, test_zy: pd.Series, test_yy: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, ta, tb, tyy, rows in zip(zz, zy, test_zz, test_zy, test_yy, n, strict=True):
            beta = np.linalg.solve(_full(np.asarray(a), d) + penalty * np.eye(d), np.asarray(b))
            if not rows:
                out.append((beta, None, None, None))
                continue
            square = max(0.0, tyy - 2 * beta @ np.asarray(tb) + beta @ _full(np.asarray(ta), d) @ beta)
            # Below this a spread is what rounding leaves of equal targets.
            spread = tyy - tb[0] * tb[0] / rows
            out.append((beta, np.sqrt(square / rows), 1 - square / spread if spread > 1e-12 * tyy else None, (np.asarray(ta)[_first_column(d)] @ beta - tb[0]) / rows))
        return pd.DataFrame(out, columns=["coefficients", "rmse", "r2", "bias"])

    def packed(part: str) -> tuple[Column, Column]:
        return F.array(*[F.col(f"{part}_zz{i}_{j}") for i in range(d) for j in range(i + 1)]), F.array(*[F.col(f"{part}_zy{i}") for i in range(d)])

    return sums.withColumn("model", model(*packed("train"), *packed("test"), F.col("test_yy"), F.col("test_n")))


def _first_column(d: int) -> list[int]:
    """Where a lower half, written by rows, has the first column."""
    return [i * (i + 1) // 2 for i in range(d)]


def predictions(rows: DataFrame, models: DataFrame, features: list[str], target: str, known: str, keys: tuple[str, ...] = ("symbol",), plan: Plan = Plan(), days: DataFrame | None = None) -> DataFrame:
    """The test rows of every split with its model's prediction: keys, dt, split_id, ``actual`` and ``predicted``. ``models`` is what ``fit`` gave; rows of a group without a model in a split are left out."""
    days = calendar(rows) if days is None else days
    count, begin = plan.splits(days.count()), plan.train + plan.gap
    at = _placed(rows, days, features, target, known, list(keys))
    tested = at.withColumn("split_id", F.explode(_splits_of(F.col("day"), begin, plan.span, plan, count)))
    own = models.select(*[F.col(c).alias(f"key{i}") for i, c in enumerate(keys)], "split_id", "coefficients")
    value = sum((F.col("coefficients")[i] * F.col(f"x{i}") for i in range(1, len(features) + 1)), F.col("coefficients")[0])
    return tested.join(own, [*[f"key{i}" for i in range(len(keys))], "split_id"]).select(*[F.col(f"key{i}").alias(c) for i, c in enumerate(keys)], "dt", "split_id", F.col("y").alias("actual"), value.alias("predicted"))
