"""From scores to signals: forecasts, verdicts, ensembles, ranked reports and hold-out metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.clean import next_business_day
from tidemark.sources.scratch import written


def direction_of(prob: Column) -> Column:
    return F.when(prob > 0.55, "UP").when(prob < 0.45, "DOWN").otherwise("NEUTRAL")


def forecast(rows: DataFrame) -> DataFrame:
    """symbol, dt, last_close, predicted_log_return to the next business day's price; returns are bounded by 0.2, unknown ones are 0."""
    r = F.least(F.greatest(F.coalesce("predicted_log_return", F.lit(0.0)), F.lit(-0.2)), F.lit(0.2))
    out = rows.withColumn("prediction_date", next_business_day(F.col("dt"))).withColumn("predicted_price", F.col("last_close") * F.exp(r))
    return out.withColumn("predicted_return", F.try_divide("predicted_price", "last_close") - 1)


def verdict(rows: DataFrame) -> DataFrame:
    """By symbol, from dir_prob, intensity and change: label, confidence and reason."""
    means = rows.groupBy("symbol").agg(F.avg("dir_prob").alias("d"), F.avg(F.abs("intensity")).alias("i"), F.avg("change").alias("c"))
    d, i, c = F.col("d"), F.col("i"), F.col("c")
    # bounds on mean probability and change: beyond the outer ones a signal is strong, beyond the inner ones moderate
    strong_up, strong_down, up, down = (d > 0.65) & (c > 1), (d < 0.35) & (c < -1), (d > 0.55) & (c > 0.3), (d < 0.45) & (c < -0.3)
    return means.select(
        "symbol",
        F.when(strong_up, "BULLISH").when(strong_down, "BEARISH").when(up, "BULLISH").when(down, "BEARISH").otherwise("NEUTRAL").alias("verdict"),
        F.when(strong_up | strong_down, F.least(F.lit(95.0), 60 + i * 30)).when(up | down, F.least(F.lit(75.0), 50 + i * 20)).otherwise(40 + 20 * F.least(F.lit(1.0), i)).alias("confidence"),
        F.when(strong_up, "Strong upward momentum with high conviction").when(strong_down, "Strong downward pressure with high conviction").when(up, "Moderate upward trend with positive signals").when(down, "Moderate downward trend with negative signals").otherwise("Mixed signals with no clear directional bias").alias("reason"),
    )


#: Weights of the three models' returns; those of the models present are made to sum to 1.
MODEL_WEIGHTS = {"dl_ret": 0.6, "lgbm_ret": 0.25, "xgb_ret": 0.15}


def ensemble(rows: DataFrame, least_move: float = 0.003, band: tuple[float, float] = (0.48, 0.52)) -> DataFrame:
    """One row of returns of up to three models, dir_prob, intensity and last_close to an action. Any doubt means no trade and costs a quarter of the confidence."""
    weight = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in MODEL_WEIGHTS.items())
    total = sum(F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in MODEL_WEIGHTS.items())
    out = rows.withColumn("final_ret", F.try_divide(total, weight))
    signs = F.array_distinct(F.array_compact(F.array(*[F.signum(c) for c in MODEL_WEIGHTS])))
    doubts = F.array_compact(
        F.array(
            F.when((F.col("dir_prob") > band[0]) & (F.col("dir_prob") < band[1]), "DL dir prob near 0.5"),
            F.when(F.abs("final_ret") < least_move, "Ensemble expected move too small"),
            F.when(F.size(signs) > 1, "Model disagreement (DL vs trees)"),
        )
    )
    out = out.withColumn("no_trade_reasons", doubts).withColumn("_n", F.size("no_trade_reasons"))
    return out.select(
        "symbol",
        F.when(F.col("_n") > 0, "NO_TRADE").when(F.col("final_ret") > 0, "LONG").otherwise("SHORT").alias("action"),
        (F.col("last_close") * F.exp("final_ret")).alias("target_price"),
        (F.col("final_ret") * 100).alias("expected_ret_pct"),
        F.when(F.col("_n") > 0, F.greatest(F.lit(0.0), 1 - 0.25 * F.col("_n"))).otherwise(F.least(F.lit(1.0), 0.6 + F.abs("intensity") * 0.3)).alias("confidence"),
        F.array_join("no_trade_reasons", "; ").alias("no_trade_reasons"),
    )


def ranked(predictions: DataFrame, top_n: int = 20) -> DataFrame:
    """Top and bottom ``top_n`` of each volatility class and the overall ranking, as one table by ``report``. Ties go by symbol; rows without a return don't rank."""
    known = predictions.withColumn("predicted_return", F.col("predicted_return").try_cast("double")).dropna(subset=["predicted_return"])
    up = [F.desc("predicted_return"), F.asc("symbol")]
    down = [F.asc("predicted_return"), F.desc("symbol")]
    by = Window.partitionBy("volatility_class")
    top = known.withColumn("rank", F.row_number().over(by.orderBy(*up))).filter(F.col("rank") <= top_n).withColumn("report", F.lit("top"))
    bottom = known.withColumn("rank", F.row_number().over(by.orderBy(*down))).filter(F.col("rank") <= top_n).withColumn("report", F.lit("bottom"))
    return top.unionByName(bottom).unionByName(overall(known))


def overall(known: DataFrame) -> DataFrame:
    """All rows by return, ties by symbol. The ranking is a number over the whole table: rows are sorted within ranges of (return, symbol), which Spark balances, then moved by the counts of the ranges above."""
    order = [F.desc("predicted_return"), F.asc("symbol")]
    dealt = written(known.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    local = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    above = sizes.withColumn("_above", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_above")
    return local.join(above, "_part").withColumn("rank", (F.col("rank") + F.col("_above")).cast("int")).withColumn("report", F.lit("overall")).drop("_part", "_above")


def holdout_metrics(rows: DataFrame) -> DataFrame:
    """By symbol, from base_close, actual_close, predicted_log_return, actual_log_return and dir_prob: errors of the close and the share of right directions where both sides take one."""
    guess = F.col("base_close") * F.exp("predicted_log_return")
    miss = F.col("actual_close") - guess
    want = F.when(F.col("actual_log_return") > 0.0015, 1).when(F.col("actual_log_return") < -0.0015, 0)
    said = F.when(F.col("dir_prob") > 0.55, 1).when(F.col("dir_prob") < 0.45, 0)
    return rows.groupBy("symbol").agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (1 - F.try_divide(F.sum(miss * miss), F.var_pop("actual_close") * F.count("actual_close"))).alias("r2"),
        F.coalesce(F.avg((want == said).cast("double")) * 100, F.lit(0.0)).alias("dir_hit_rate"),
    )


def scores(symbols: DataFrame, momentum: int = 126, reversion: int = 20, beta_rows: int = 60) -> DataFrame:
    """By symbol, from bars with Market: momentum over ``momentum`` rows, the last close's distance from its mean in deviations (0 with too few rows), and beta (null below ``beta_rows`` common returns)."""
    w = Window.partitionBy("symbol").orderBy("dt")
    near = w.rowsBetween(1 - reversion, 0)
    rows = symbols.select(
        "symbol", "dt", F.try_divide(F.col("Close"), F.lag("Close", momentum).over(w)).alias("grown"), ((F.col("Close") - F.avg("Close").over(near)) / (F.stddev_samp("Close").over(near) + 1e-9)).alias("away"),
        F.row_number().over(w).alias("n"), (F.try_divide(F.col("Close"), F.lag("Close").over(w)) - 1).alias("a"), (F.try_divide(F.col("Market"), F.lag("Market").over(w)) - 1).alias("b"),
    )
    last = F.max_by(F.struct("n", "grown", "away"), "dt")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    out = rows.groupBy("symbol").agg(last.alias("z"), F.covar_samp("a", "b").alias("cov"), F.var_pop(F.when(both, F.col("b"))).alias("var"), F.count(F.when(both, 1)).alias("common"))
    return out.select(
        "symbol",
        F.when(F.col("z.n") > momentum, F.col("z.grown") - 1).otherwise(0.0).alias("momentum"),
        F.when(F.col("z.n") > reversion, F.col("z.away")).otherwise(0.0).alias("reversion"),
        F.when(F.col("common") >= beta_rows, F.col("cov") / (F.col("var") + 1e-12)).alias("beta"),
    )


def prediction_table(rows: DataFrame) -> DataFrame:
    """Scored last rows (symbol, sector, volatility_class, bucket_name, dt, last_close, predicted_log_return, dir_prob, intensity, stage, path, window_start, window_end, rows_used) as the published table of predictions."""
    out = forecast(rows)
    return out.select(
        "prediction_date", F.col("dt").alias("cutoff_date"), "symbol", "sector", "volatility_class", "bucket_name", F.round("last_close", 4).alias("last_close"), F.round("predicted_price", 4).alias("predicted_price"), F.round("predicted_return", 6).alias("predicted_return"),
        direction_of(F.col("dir_prob")).alias("predicted_direction"), F.round("dir_prob", 6).alias("dir_prob"), F.round("intensity", 6).alias("intensity"), F.col("stage").alias("model_stage_used"), F.col("path").alias("parent_checkpoint_path"),
        F.col("window_start").alias("data_window_start"), F.col("window_end").alias("data_window_end"), "rows_used",
    )
