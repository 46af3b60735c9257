"""Connected components by alternating large-star and small-star steps.

Each step takes the least neighbour of every node (a grouped aggregate with partial sums before its shuffle), writes these, and joins the edges
to them. Both sides of the join are written tables, so Spark broadcasts a small one and splits the rows of a node with very many
neighbours among tasks; no neighbourhood is ever gathered in one. Rounds end when the edges no longer change; each round's edges are
written to the shared folder and those of the round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialise


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (all larger ones, or itself and the smaller ones) to the least of them and itself. ``edges`` is a written table, and is deleted."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialise(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    made = materialise(out.filter("a <> b").distinct(), "edges")
    discard(edges, least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): the least node that can be reached. Loops and repeated edges do no harm; nodes without an edge don't appear."""
    now = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        now = _starred(_starred(now, False), True)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
