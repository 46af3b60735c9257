"""Sequences, labels, scaling and leakage-aware splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("dt")


def numbered(df: DataFrame) -> DataFrame:
    """With ``i``: the row's place in its series, from 0."""
    return df.withColumn("i", F.row_number().over(series()) - 1)


def sequences(df: DataFrame, features: list[str], length: int, mask: str | None = None) -> DataFrame:
    """For each row with ``length`` rows before it (and the mask): those rows' features as ``seq``, oldest first, without its own."""
    packed = F.array(*[F.col(c).cast("float") for c in features])
    out = numbered(df).withColumn("seq", F.collect_list(packed).over(series().rowsBetween(-length, -1)))
    return out.filter((F.col("i") >= length) & (F.col(mask) if mask else F.lit(True)))


def forward_return(column: str, horizon: int) -> Column:
    """The sum of this row's value and the following ones', ``horizon`` in all; NULL where the series ends before."""
    w = series().rowsBetween(0, horizon - 1)
    return F.when(F.count(column).over(w) == horizon, F.sum(column).over(w))


def smooth(label: Column, eps: float = 0.01) -> Column:
    return (1 - eps) * label + eps / 2


def with_direction(df: DataFrame, ret: str, period: int = 14, band: float = 0.25) -> DataFrame:
    """With ``direction``: 1 or 0 if the return is beyond the band of true ranges in percent of the close, else 0.5; so is an unknown return. The first rows take the first mean range known."""
    before = F.lag("Close").over(series())
    df = df.withColumn("_tr", F.greatest(F.col("High") - F.col("Low"), F.abs(F.col("High") - before), F.abs(F.col("Low") - before)))
    w = series().rowsBetween(1 - period, 0)
    df = df.withColumn("_atr", F.when(F.count("_tr").over(w) == period, F.avg("_tr").over(w)))
    df = df.withColumn("_atr", F.first("_atr", True).over(series().rowsBetween(0, Window.unboundedFollowing)))
    unit = F.col(ret) / F.greatest(F.col("_atr") / (F.col("Close") + 1e-9), F.lit(1e-6))
    return df.withColumn("direction", F.when(unit > band, 1.0).when(unit < -band, 0.0).otherwise(0.5)).drop("_tr", "_atr")


def intensity(value: Column, mean: Column, spread: Column) -> Column:
    return F.tanh((value - mean) / (0.8 * spread))


def holdout(df: DataFrame, kind: str = "pretrain", embargo: int = 20) -> DataFrame:
    """With ``part``: train, val or null (within ``embargo`` rows of the cut). Pretraining holds out a fifth of the rows, 20 to 60; fine-tuning cuts at 80 %."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    cut = n - F.greatest(F.lit(20), F.least(F.lit(60), F.floor(n / 5))) if kind == "pretrain" else F.floor(0.8 * n)
    out = numbered(df).withColumn("cut", cut.cast("long"))
    return out.withColumn("part", F.when(F.col("i") < F.col("cut") - embargo, "train").when(F.col("i") >= F.col("cut") + embargo, "val"))


def last_rows(df: DataFrame, length: int = 90, least: int = 60, most: int = 200) -> DataFrame:
    """The last max(length + least, most) rows of symbols that have length + least."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("dt")))
    return df.withColumn("_n", n).withColumn("_b", back).filter((F.col("_n") >= length + least) & (F.col("_b") <= max(length + least, most))).drop("_n", "_b")


def walk_forward(days: DataFrame, train: int = 756, purge: int = 20, embargo: int = 20, test: int = 252, step: int = 126) -> DataFrame:
    """Splits of a calendar (one column dt): train days, a purge, an embargo and test days, each split ``step`` days after the one before, numbered from 0."""
    numbered_days = days.distinct().withColumn("i", F.row_number().over(Window.orderBy("dt")) - 1)
    span = train + purge + embargo + test
    total = numbered_days.agg(F.count("*").alias("n"))
    splits = total.filter(F.col("n") >= span).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - span) / step).cast("int"))).alias("split_id"))
    ends = {"train_start": 0, "train_end": train - 1, "test_start": train + purge + embargo, "test_end": span - 1}
    for name, offset in ends.items():
        day = numbered_days.select(F.col("dt").alias(name), F.col("i").alias("_i"))
        splits = splits.join(day, F.col("_i") == F.col("split_id") * step + offset).drop("_i")
    return splits.select("split_id", "train_start", "train_end", F.lit(purge).alias("purge_days"), F.lit(embargo).alias("embargo_days"), "test_start", "test_end", F.lit(train).alias("train_days"), F.lit(test).alias("test_days"))


def scale(df: DataFrame, columns: list[str], kind: str = "minmax", train: str = "part", low: float = -500.0, high: float = 500.0) -> DataFrame:
    """Columns scaled by statistics of each symbol's training rows; without spread the scale is 1; min-max results are clipped."""
    is_train = F.col(train) == "train"
    w = Window.partitionBy("symbol")
    made = {}
    for c in columns:
        x = F.when(is_train, F.col(c))
        if kind == "minmax":
            a, b = F.min(x).over(w), F.max(x).over(w)
            made[f"{c}_scaled"] = F.least(F.greatest((F.col(c) - a) / F.when(b > a, b - a).otherwise(1.0), F.lit(low)), F.lit(high))
        else:
            m, s = F.avg(x).over(w), F.stddev_pop(x).over(w)
            made[f"{c}_scaled"] = (F.col(c) - m) / F.when(s > 0, s).otherwise(1.0)
    return df.withColumns(made)


def tabular(df: DataFrame, features: list[str], ret: str = "LogRet") -> DataFrame:
    """Rows without a missing feature, with the next row's return as ``y``."""
    return df.withColumn("y", F.lead(ret).over(series())).dropna(subset=[*features, "y"]).select("symbol", "dt", *features, "y")
