"""Cleaning: names, numbers, dates, windows of time, fills."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Calendar days that a training stage looks back from its cutoff, both ends included; a stage without a number sees all.
STAGE_DAYS = {"monthly": 365, "weekly": 180, "daily": 90}
#: Public names of bar columns by their lower-case source names.
BAR_NAMES = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "change %": "Change %"}
#: Source names of a date column, in order of preference.
DATE_NAMES = ("Date", "date", "Datetime", "datetime", "timestamp")


def standardise_columns(df: DataFrame, names: dict[str, str] = BAR_NAMES) -> DataFrame:
    """Renames by the trimmed lower-case name, or the exact one; others stay."""
    return df.withColumnsRenamed({c: names.get(c.strip().lower(), names.get(c.strip(), c)) for c in df.columns})


def number(column: Column) -> Column:
    """Text such as ``3,000`` or ``1.5%`` as a double; NULL if it isn't one."""
    return F.regexp_replace(column.cast("string"), "[,%]", "").try_cast("double")


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as far as they are there."""
    return df.withColumns({c: number(F.col(f"`{c}`")) for c in columns if c in df.columns})


def parse_dates(df: DataFrame, names: tuple[str, ...] = DATE_NAMES, out: str = "dt") -> DataFrame:
    """The first date of the columns that are there."""
    found = [F.try_to_timestamp(F.col(c).cast("string")).cast("date") for c in names if c in df.columns]
    return df.withColumn(out, F.coalesce(*found) if found else F.lit(None).cast("date"))


def until(df: DataFrame, cutoff: str, dt: str = "dt") -> DataFrame:
    """Rows up to the cutoff, whatever the column is called."""
    return df.filter(F.col(dt) <= F.lit(cutoff).cast("date"))


def stage_window(df: DataFrame, stage: str, cutoff: str, dt: str = "dt") -> DataFrame:
    """Rows that a training stage sees. An unknown stage looks back as far as the shortest."""
    return df.filter(in_stage(F.col(dt), stage, cutoff))


def in_stage(dt: Column, stage: str, cutoff: str) -> Column:
    """Whether a stage sees a day."""
    last = F.lit(cutoff).cast("date")
    return (dt <= last) if stage == "yearly" else (dt <= last) & (dt >= F.date_sub(last, STAGE_DAYS.get(stage, min(STAGE_DAYS.values()))))


def with_history(df: DataFrame, least: int = 60, key: str = "symbol") -> DataFrame:
    """Rows of symbols with at least so many."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter(F.col("_n") >= least).drop("_n")


def fill(df: DataFrame, columns: list[str], backward: bool = True, key: str = "symbol", dt: str = "dt") -> DataFrame:
    """Gaps take the last value before them, and then, if ``backward``, the first one after."""
    w = Window.partitionBy(key).orderBy(dt)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    made = {c: F.coalesce(F.last(c, True).over(past), *([F.first(c, True).over(future)] if backward else [])) for c in columns}
    return df.withColumns(made)


def safe_log(column: Column) -> Column:
    return F.ln(F.when(column > 0, column))


def bounded(column: Column, low: float = -1e6, high: float = 1e6) -> Column:
    """NULL for NaN and infinity, else within the bounds; ``nan_to_num`` is this with a coalesce."""
    ok = F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
    return F.when(ok.isNotNull(), F.least(F.greatest(ok, F.lit(low)), F.lit(high)))


def usable_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those that are there and have a value: one pass of counts."""
    there = [c for c in columns if c in df.columns]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(there)]).first() if there else ()
    return [c for c, n in zip(there, counts, strict=True) if n]


def latest_date(*tables: DataFrame, dt: str = "dt") -> DataFrame:
    """The last date of all tables; reads that column only."""
    return reduce(DataFrame.unionByName, [t.select(dt) for t in tables]).agg(F.max(dt).alias("latest"))


def next_business_day(column: Column) -> Column:
    """The next day from Monday to Friday."""
    return F.date_add(column, F.when(F.dayofweek(column) == 6, 3).when(F.dayofweek(column) == 7, 2).otherwise(1))
