"""Portfolio analytics over an equity curve (dt, equity, ret, exposure, positions) and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def metrics(curve: DataFrame) -> DataFrame:
    """One row: growth, Sharpe, Sortino, drawdown, Calmar, win rate, volatility and exposure. A year is 365.25 days of the calendar and 252 of trading.

    The highest equity so far is a running maximum over one curve, which is one row a day."""
    peak = F.max("equity").over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumn("dd", F.col("equity") / peak - 1)
    one = rows.agg(
        F.min("dt").alias("start_date"), F.max("dt").alias("end_date"), F.min_by("equity", "dt").alias("start_value"), F.max_by("equity", "dt").alias("end_value"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"),
        F.sqrt(F.avg(F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2)))).alias("down"), F.min("dd").alias("MaxDD"), F.avg((F.col("ret") > 0).cast("double")).alias("Daily_Win_Rate"), F.avg("exposure").alias("avg_exposure"), F.avg("positions").alias("avg_positions"),
    )
    years = F.datediff("end_date", "start_date") / 365.25
    out = one.withColumn("total_return", F.col("end_value") / F.col("start_value") - 1).withColumn("CAGR", F.pow(F.col("end_value") / F.col("start_value"), 1 / F.when(years > 0, years)) - 1)
    return out.select(
        "start_date", "end_date", "start_value", "end_value", "total_return", "CAGR", F.try_divide(F.col("m") * F.sqrt(F.lit(float(DAYS))), F.col("s")).alias("Sharpe"), F.try_divide(F.col("m") * F.sqrt(F.lit(float(DAYS))), F.col("down")).alias("Sortino"), "MaxDD",
        F.try_divide(F.col("CAGR"), F.abs("MaxDD")).alias("Calmar"), "Daily_Win_Rate", (F.col("s") * F.sqrt(F.lit(float(DAYS)))).alias("Ann_Vol"), "avg_exposure", "avg_positions",
    )


def by_regime(curve: DataFrame) -> DataFrame:
    """Mean return, Sharpe, hit rate and exposure by trend, by volatility, and by both: one pass of grouping sets."""
    grouped = curve.groupingSets([["trend"], ["vol"], ["trend", "vol"]], "trend", "vol").agg(
        F.grouping_id().alias("g"), F.count("*").alias("observations"), F.avg("ret").alias("mean_daily_ret"), F.try_divide(F.avg("ret") * F.sqrt(F.lit(float(DAYS))), F.stddev_samp("ret")).alias("sharpe"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.avg("exposure").alias("avg_exposure"),
    )
    kind = F.when(F.col("g") == 1, "trend").when(F.col("g") == 2, "vol").otherwise("trend_vol")
    return grouped.select(kind.alias("regime_type"), F.concat_ws("_", "trend", "vol").alias("regime"), "observations", "mean_daily_ret", "sharpe", "hit_rate", "avg_exposure")


def by_year(curve: DataFrame) -> DataFrame:
    out = curve.groupBy(F.year("dt").alias("year")).agg(F.min_by("equity", "dt").alias("start_equity"), F.max_by("equity", "dt").alias("end_equity"))
    return out.withColumn("year_return", F.col("end_equity") / F.col("start_equity") - 1)


def trade_metrics(trades: DataFrame, capital: float) -> DataFrame:
    """Hit rate, profit factor, mean return and holding time, cost and turnover of trades (net_pnl, net_return, holding_days, total_cost, entry_value, exit_value)."""
    won, lost = F.sum(F.greatest("net_pnl", F.lit(0.0))), F.sum(F.least("net_pnl", F.lit(0.0)))
    return trades.agg(
        F.count("*").alias("total_trades"), F.countDistinct("symbol").alias("unique_traded_stocks"), F.avg((F.col("net_pnl") > 0).cast("double")).alias("trade_hit_rate"), F.try_divide(won, F.abs(lost)).alias("profit_factor"),
        F.avg("net_return").alias("avg_trade_return"), F.avg("holding_days").alias("avg_holding_days"), F.sum("total_cost").alias("total_cost_drag"), (F.sum(F.col("entry_value") + F.col("exit_value")) / capital).alias("turnover_multiple"),
    )


def extreme_trades(trades: DataFrame, n: int = 5) -> DataFrame:
    """The best and worst trades by profit, ties by symbol and entry."""
    keys = ["symbol", "entry_date"]
    best = trades.orderBy(F.desc("net_pnl"), *keys).limit(n).withColumn("kind", F.lit("top"))
    return best.unionByName(trades.orderBy(F.asc("net_pnl"), *keys).limit(n).withColumn("kind", F.lit("worst")))


def capacity(traded: DataFrame, top_k: int = 10, liquidity_min: float = 0.0) -> DataFrame:
    """Median and lower quartile of the mean daily traded value (symbol, value) of symbols liquid enough, and what a tenth of it in ``top_k`` positions takes."""
    adv = traded.groupBy("symbol").agg(F.avg("value").alias("adv")).filter(F.col("adv") >= liquidity_min)
    out = adv.agg(F.percentile("adv", F.lit(0.5)).alias("median_adv_selected"), F.percentile("adv", F.lit(0.25)).alias("p25_adv_selected"))
    return out.select(F.lit(top_k).alias("top_k"), F.lit(liquidity_min).alias("liquidity_min"), "*", (F.col("median_adv_selected") * 0.1 * top_k).alias("capacity_10pct_adv_median"), (F.col("p25_adv_selected") * 0.1 * top_k).alias("capacity_10pct_adv_p25"))


def trend_following(bars: DataFrame, capital: float = 1_000_000.0, fraction: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """A rule to have something to measure: hold a symbol on the day after a close above its 20-row mean, equal weights, with a fraction of the capital. Gives the curve with regimes, and the trades (runs of held days)."""
    w = Window.partitionBy("symbol").orderBy("dt")
    near = w.rowsBetween(-19, 0)
    rows = bars.select("symbol", "dt", "Close", F.ln(F.try_divide(F.col("Close"), F.lag("Close").over(w))).alias("r"), F.when(F.count("Close").over(near) == 20, F.col("Close") > F.avg("Close").over(near)).otherwise(False).alias("above"))
    rows = rows.withColumn("held", F.coalesce(F.lag("above").over(w), F.lit(False)))
    daily = rows.groupBy("dt").agg((fraction * F.avg(F.when(F.col("held"), F.coalesce("r", F.lit(0.0))).otherwise(0.0))).alias("log_ret"), F.avg(F.col("held").cast("double")).alias("exposure"), F.sum(F.col("held").cast("int")).alias("positions"), F.avg("r").alias("market"))
    order = Window.orderBy("dt")
    curve = daily.withColumn("equity", F.lit(capital) * F.exp(F.sum("log_ret").over(order.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("ret", F.exp("log_ret") - 1)
    far = order.rowsBetween(-59, 0)
    curve = curve.withColumn("drift", F.avg("market").over(far)).withColumn("noise", F.coalesce(F.stddev_samp("market").over(far), F.lit(0.0)))
    curve = curve.withColumn("trend", F.when(F.col("drift") > 0.002, "BULL").when(F.col("drift") < -0.002, "BEAR").otherwise("NEUTRAL")).withColumn("vol", F.when(F.col("noise") > 0.5, "HIGH_VOL").when(F.col("noise") < 0.3, "LOW_VOL").otherwise("MID_VOL"))
    runs = rows.withColumn("n", F.row_number().over(w)).withColumn("g", F.col("n") - F.sum(F.col("held").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("held")
    trades = runs.groupBy("symbol", "g").agg(F.min("dt").alias("entry_date"), F.max("dt").alias("exit_date"), F.min_by("Close", "dt").alias("entry_value"), F.max_by("Close", "dt").alias("exit_value"), F.count("*").alias("bars"))
    cost = 0.001 * (F.col("entry_value") + F.col("exit_value"))
    trades = trades.withColumn("total_cost", cost).withColumn("net_pnl", F.col("exit_value") - F.col("entry_value") - F.col("total_cost"))
    return curve, trades.withColumn("net_return", F.col("net_pnl") / F.col("entry_value")).withColumn("holding_days", F.datediff("exit_date", "entry_date")).drop("g")
