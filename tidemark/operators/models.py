"""Scorers behind one interface: a fitted pipeline, or any function over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_baseline(train: DataFrame, features: list[str], ret: str = "y", trees: bool = False):
    """A return regressor and a direction classifier over a training table; both distributed."""
    steps = [VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True)]
    regress = GBTRegressor(featuresCol="_z", labelCol=ret, predictionCol="predicted_log_return", maxIter=20, maxDepth=4, seed=7) if trees else LinearRegression(featuresCol="_z", labelCol=ret, predictionCol="predicted_log_return", regParam=0.01)
    classify = LogisticRegression(featuresCol="_z", labelCol="_up", probabilityCol="_p", predictionCol="_d", rawPredictionCol="_r", regParam=0.01)
    return Pipeline(stages=[*steps, regress, classify]).fit(train.withColumn("_up", (F.col(ret) > 0).cast("double")))


def score(model, rows: DataFrame) -> DataFrame:
    """``rows`` with predicted_log_return and dir_prob."""
    out = model.transform(rows.withColumn("_up", F.lit(0.0)))
    return out.withColumn("dir_prob", vector_to_array("_p")[1]).drop("_x", "_z", "_p", "_d", "_r", "_up")


def score_with(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any scorer over batches of rows: the place for a network or boosted trees trained elsewhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)


def spike_weighted(y: Column, prediction: Column) -> Column:
    """A row's squared error, weighted by the size of the move."""
    return (1.5 + 3.5 * F.pow(F.abs(y), F.lit(1.5))) * (y - prediction) * (y - prediction)


def smooth_huber(y: Column, prediction: Column, delta: float = 0.05) -> Column:
    """A row's Huber loss over ``delta``: quadratic up to it, linear beyond."""
    e = F.abs(y - prediction)
    return F.when(e < delta, 0.5 * e * e / delta).otherwise(e - 0.5 * delta)


def focal_soft(label: Column, prob: Column, alpha: float = 0.5, gamma: float = 2.0) -> Column:
    """A row's focal loss of a soft label: of the probability that the label gives, both ways together."""
    p = F.least(F.greatest(prob, F.lit(1e-7)), F.lit(1 - 1e-7))
    right = label * p + (1 - label) * (1 - p)
    return -alpha * F.pow(1 - right, F.lit(gamma)) * F.ln(right)


def losses(rows: DataFrame) -> DataFrame:
    """Evaluation losses of y, prediction, label, prob: their means over all rows."""
    made = {"weighted_mse": spike_weighted(F.col("y"), F.col("prediction")), "huber": smooth_huber(F.col("y"), F.col("prediction")), "focal": focal_soft(F.col("label"), F.col("prob"))}
    return rows.agg(*[F.avg(v).alias(k) for k, v in made.items()])
