"""Runs compiled formulas: as Spark plans, level by level, or as one DuckDB statement."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import kernels
from tidemark.plans.formula import Column, Compiler


def by_key(df: DataFrame, key: str = "symbol") -> DataFrame:
    """``df`` exchanged by ``key`` into the session's number of shuffle partitions. That number is explicit, as windows over a series take far more time than its bytes tell: left to its size, a small table would be one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def compute(bars: DataFrame, formulas: dict[str, str], names: list[str], key: str = "symbol", order: str = "dt") -> DataFrame:
    """``bars`` (one row for each key and time) with the named formulas. Only what they need is computed.

    All windows and kernels share one partitioning and one order. Each level of recursions or whole-series ranks is one grouped kernel, whose rows are
    exchanged once more, as Spark takes them for unpartitioned; those of recursions come before all other windows, over the few columns that they need.
    """
    compiler = Compiler(formulas, {*bars.columns, "rn"}, key, order)
    levels = compiler.levels(names)
    df = bars.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    later = _used_after(levels, names)
    for columns, keep in zip(levels, later, strict=True):
        if columns[0].kernel:
            df = _kernel(df, columns, [c for c in df.columns if c in keep or c in bars.columns or c == "rn"], key, order)
        else:
            df = df.selectExpr(*[c for c in df.columns if c in keep or c in bars.columns or c == "rn"], *[f"{c.text['spark']} AS {c.name}" for c in columns])
    return df.select(*bars.columns, *[n for n in names if n not in bars.columns])


def _used_after(levels: list[list[Column]], names: list[str]) -> list[set[str]]:
    """For each level, the columns that it or a later one hands on."""
    out, used = [], set(names)
    for columns in reversed(levels):
        out.append(set(used))
        for c in columns:
            used |= c.reads
    return out[::-1]


def _kernel(df: DataFrame, columns: list[Column], hand_on: list[str], key: str, order: str) -> DataFrame:
    """One grouped pass for all recursions and orders of a level. Of the columns, what no one needs later goes no further."""
    jobs = [(c.name, *c.kernel) for c in columns]
    inputs = {i for _, _, names, _ in jobs for i in names}
    df = df.select(*[c for c in df.columns if c in inputs or c in hand_on])
    schema = T.StructType([*[df.schema[c] for c in hand_on], *(T.StructField(c.name, T.DoubleType()) for c in columns)])

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, sort_keys=[(order, "ascending")]))
        series = {i: table[i].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for i in inputs}
        made = kernels.run([job[1:] for job in jobs], series)
        table = table.select(hand_on)
        for (name, *_), values in zip(jobs, made, strict=True):
            table = table.append_column(name, pa.array(values, from_pandas=True))
        return table

    # Spark doesn't know that a kernel hands on its partitioning
    return by_key(df.groupBy(key).applyInArrow(run, schema), key)


def statement(base: str, base_columns: list[str], formulas: dict[str, str], names: list[str], key: str = "symbol", order: str = "dt", prefix: str = "x") -> str:
    """CTEs and a last SELECT in DuckDB SQL over ``base`` (the text of a SELECT): key, order and the named formulas."""
    compiler = Compiler(formulas, {*base_columns, "rn"}, key, order)
    levels = compiler.levels(names)
    ctes = [f"{prefix}0 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({base}))"]
    for i, columns in enumerate(levels, 1):
        ctes.append(f"{prefix}{i} AS (SELECT *, {', '.join(f'{c.text['duckdb']} AS {c.name}' for c in columns)} FROM {prefix}{i - 1})")
    return f"WITH {', '.join(ctes)} SELECT {key}, {order}, {', '.join(names)} FROM {prefix}{len(levels)}"
