"""Writers: bars, predictions, reports, sequences, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import versions


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol; a rerun replaces the symbols that it has."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "dt").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("symbol").parquet(path)


def write_predictions(predictions: DataFrame, path: str, cutoff: str) -> bool:
    """One CSV with a header for a cutoff; nothing without rows."""
    if predictions.isEmpty():
        return False
    predictions.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/cutoff={cutoff}")
    return True


def write_indices(history: DataFrame, path: str) -> None:
    """Histories of indices (dt, name, close) by name, in a table of ``versions``; a rerun replaces the indices that it has, all at once."""
    versions.write(history, path, "name")


def write_reports(reports: DataFrame, path: str, cutoff: str) -> None:
    """Ranked reports by kind and volatility class."""
    reports.withColumn("cutoff", F.lit(cutoff)).repartition("report", "volatility_class").write.mode("overwrite").option("header", True).partitionBy("cutoff", "report", "volatility_class").csv(path)


def write_sequences(sequences: DataFrame, path: str, stage: str, cutoff: str) -> None:
    sequences.withColumn("stage", F.lit(stage)).withColumn("cutoff", F.lit(cutoff)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("stage", "cutoff", "symbol").parquet(path)


def write_state(state: DataFrame, path: str) -> None:
    state.coalesce(1).write.mode("overwrite").json(path)
