"""Coarser bars, as-of joins and their combination: weekly and monthly columns on daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import MONTHLY, MONTHLY_COLUMNS, WEEKLY, WEEKLY_COLUMNS
from tidemark.plans import engine

#: Ends of periods: the Friday on or after the day, the month's last day.
PERIOD_END = {
    "weekly": (lambda dt: F.next_day(F.date_sub(dt, 1), "FR"), "dt + CAST((12 - isodow(dt)) % 7 AS INTEGER)"),
    "monthly": (F.last_day, "last_day(dt)"),
}
#: With this many periods or fewer, a series has no coarser columns; they are zero.
FEW_PERIODS = 5


def resample(bars: DataFrame, period: str) -> DataFrame:
    """First open, highest high, lowest low, last close and summed volume of each period with bars."""
    end = PERIOD_END[period][0](F.col("dt"))
    return bars.groupBy("symbol", end.alias("dt")).agg(
        F.min_by("Open", "dt").alias("Open"), F.max("High").alias("High"), F.min("Low").alias("Low"), F.max_by("Close", "dt").alias("Close"), F.sum("Volume").alias("Volume"),
    )


def resample_sql(bars: str, period: str) -> str:
    end = PERIOD_END[period][1]
    return f"SELECT symbol, CAST({end} AS DATE) AS dt, min_by(Open, dt) AS Open, max(High) AS High, min(Low) AS Low, max_by(Close, dt) AS Close, sum(Volume) AS Volume FROM ({bars}) GROUP BY symbol, CAST({end} AS DATE)"


def asof_join(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of its key not after it; NULLs of that row stay. One exchange: both sides are laid into one series and the last
    right row is carried on."""
    packed = F.struct(*columns)
    kind = right.select(packed.alias("p")).schema["p"].dataType
    both = left.withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast(kind)).unionByName(right.select(key, order, F.lit(0).alias("_side"), packed.alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select(*left.columns, *[F.col(f"_p.{c}").alias(c) for c in columns])


def with_coarse(bars: DataFrame) -> DataFrame:
    """Daily rows with the weekly and monthly columns as of the day. Rows are exchanged by symbol once; both periods are laid into the daily series and carried on in one pass."""
    bars = engine.by_key(bars)
    both = bars.withColumn("_side", F.lit(1))
    parts = (("weekly", WEEKLY, WEEKLY_COLUMNS), ("monthly", MONTHLY, MONTHLY_COLUMNS))
    for period, formulas, columns in parts:
        every = F.count("*").over(Window.partitionBy("symbol"))
        coarse = engine.compute(resample(bars, period).withColumn("_n", every), formulas, list(columns))
        known = [F.when(F.col("_n") > FEW_PERIODS, F.col(c)).otherwise(0.0).alias(c) for c in columns]
        both = both.unionByName(coarse.select("symbol", "dt", F.lit(0).alias("_side"), F.struct("_n", *known).alias(period)), allowMissingColumns=True)
    both = engine.by_key(both)
    w = Window.partitionBy("symbol").orderBy("dt", "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol")
    carried = both.select(*bars.columns, "_side", *[F.last(p, ignorenulls=True).over(w).alias(p) for p, _, _ in parts], *[F.max(F.col(f"{p}._n")).over(whole).alias(f"_{p}") for p, _, _ in parts]).filter("_side = 1")
    # before a series' first period its columns are unknown, unless the series has too few periods at all
    made = [F.when(F.col(f"_{p}") > FEW_PERIODS, F.col(f"{p}.{c}")).otherwise(0.0).alias(c) for p, _, columns in parts for c in columns]
    return carried.select(*bars.columns, *made)


def with_coarse_sql(bars: str, bar_columns: list[str]) -> str:
    for period, formulas, columns in (("weekly", WEEKLY, WEEKLY_COLUMNS), ("monthly", MONTHLY, MONTHLY_COLUMNS)):
        coarse = engine.statement(resample_sql(bars, period), ["symbol", "dt", "Open", "High", "Low", "Close", "Volume"], formulas, list(columns), prefix=f"{period}_")
        got = ", ".join(f"CASE WHEN k.n > {FEW_PERIODS} THEN w.{c} ELSE 0e0 END AS {c}" for c in columns)
        own = ", ".join(f"b.{c}" for c in bar_columns)
        bars = f"SELECT {own}, {got} FROM ({bars}) b ASOF LEFT JOIN ({coarse}) w ON b.symbol = w.symbol AND b.dt >= w.dt LEFT JOIN (SELECT symbol, count(*) AS n FROM ({coarse}) GROUP BY symbol) k ON b.symbol = k.symbol"
        bar_columns = [*bar_columns, *columns]
    return bars
