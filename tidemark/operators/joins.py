"""Joins of series: indices onto bars, folds of many series, membership, newest of several, keep-last upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import fill, safe_log
from tidemark.plans.engine import by_key

#: Order in which checkpoints of stages are preferred.
STAGES = ("daily", "weekly", "monthly", "yearly")


def integrate(bars: DataFrame, indices: DataFrame, core: tuple[str, ...] = ("NIFTY50", "SENSEX")) -> DataFrame:
    """Bars (with ``sector_index_name``) with the core indices and their own sector's, filled both ways, their logarithms, and the close's change in percent.

    ``indices`` is long (dt, name, close), one close for each day and name. The core ones are one small table by day, the sector's index is picked by a join on day and name.
    """
    wide = indices.filter(F.col("name").isin(*core)).groupBy("dt").agg(*[F.max(F.when(F.col("name") == name, F.col("close"))).alias(name) for name in core])
    out = bars.join(wide, "dt", "left")
    own = indices.select("dt", F.col("name").alias("sector_index_name"), F.col("close").alias("sector_index_value"))
    out = out.join(own, ["dt", "sector_index_name"], "left")
    out = fill(by_key(out), [*core, "sector_index_value"])
    first = F.coalesce("sector_index_value", F.col(core[0]))
    out = out.withColumn("sector_index_value", first).withColumns({f"log_{c}": safe_log(F.col(c)) for c in (*core, "sector_index_value")})
    out = fill(out, [f"log_{c}" for c in (*core, "sector_index_value")])
    before = F.lag("Close").over(Window.partitionBy("symbol").orderBy("dt"))
    return out.withColumn("close_pct_change", F.coalesce((F.try_divide(F.col("Close"), before) - 1) * 100, F.lit(0.0)))


def fold(series: DataFrame, names: list[str]) -> DataFrame:
    """Long (dt, name, close) to one row for each day of any series, with a column for each: a full outer join of all, as one aggregate."""
    return series.groupBy("dt").pivot("name", names).agg(F.first("close"))


def pending(symbols: DataFrame, done: DataFrame) -> DataFrame:
    return symbols.join(done, "symbol", "left_anti")


def finished(symbols: DataFrame, done: DataFrame) -> DataFrame:
    return symbols.join(done, "symbol", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the new one's."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_age")
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_age")


def best_checkpoint(wanted: DataFrame, registry: DataFrame) -> DataFrame:
    """For each (symbol, bucket) the best checkpoint of its symbol or its bucket: by stage in order of ``STAGES``, then the newest cutoff, then the symbol's own.

    The registry is brought down to the best of each symbol and of each bucket before it is joined."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    order = F.struct(F.when(place > 0, place).otherwise(len(STAGES) + 1).alias("place"), (-F.unix_date("cutoff")).alias("age"), F.col("path"), F.col("stage"), F.col("cutoff"))
    own = registry.filter("symbol IS NOT NULL").groupBy("symbol").agg(F.min(order).alias("own"))
    shared = registry.filter("symbol IS NULL AND bucket IS NOT NULL").groupBy("bucket").agg(F.min(order).alias("shared"))

    def ranked(name: str, level: int):
        c = F.col(name)
        return F.when(c.isNotNull(), F.struct(c["place"].alias("place"), c["age"].alias("age"), F.lit(level).alias("level"), c["path"].alias("path"), c["stage"].alias("stage"), c["cutoff"].alias("cutoff")))

    both = wanted.join(own, "symbol", "left").join(shared, "bucket", "left").withColumn("best", F.least(ranked("own", 0), ranked("shared", 1)))
    return both.filter("best IS NOT NULL").select("symbol", "bucket", "best.stage", "best.cutoff", "best.path")
