"""Mixing of sources to target weights by pivotal dependent rounding through a distributed reduction tree.

``targets`` shares a total of words among sources by weight; a source stops at ``most`` times its size and the excess is reshared
by weight until none is above. ``mix`` turns a source's target into copies of its documents: each has the expected number target /
size of its source, of which the whole part is given and the fraction is rounded. Two documents at a time, a random one
gives words to the other until the fraction of one is 0 or 1; the direction is drawn so that no expectation changes, and as
words, not copies, are moved, their sum stays. What is left of a block of a source's rows is one fraction; these residuals
are paired again, ``fan`` at a time, up a tree of blocks until a source has one left, for which a coin decides. So the words taken of
a source differ from its target by less than its longest document.

Blocks are drawn by a hash of the whole row, as many as a source's rows need; a source with a third of all rows is many blocks. Rows that are
equal in all columns hash alike: where more of them than ``block_rows // 8`` do, they are numbered (by input partition, then within it) and drawn by
their number too, so that they spread over all blocks of the source; as they are interchangeable, which of them has which number makes no
difference. All coins are hashes of rows and the seed, so that reruns agree, however the table is partitioned. Sources are ranked by ranges of
names and their targets found by rounds of sums, so that there may be any number of them.

Nulls: a null source is a source of its own, last in order; a null text has size 0. A document of size 0 carries no words; its
fraction is rounded alone. Repeated rows are documents of their own. An empty table gives an empty one. Other columns are kept;
those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, mix64

BLOCK_ROWS, BLOCK_WORDS, FAN = 2000, 2_000_000, 64
#: A fraction so near to 0 or 1 is it.
_EPS = 1e-9


def word_count(text: str = "text"):
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size, source_rows) with ``target``. Weights repeat over the sources in order of code points, null last; the total is ``share`` of all sizes."""
    order = F.col("source").asc_nulls_last()
    rows = materialise(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    # places: of a row in its range, and of the ranges
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).join(first, "part")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("first") + F.col("place")) % len(weights) + 1).cast("int"))
    rows = materialise(rows.select("source", "source_size", "source_rows", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")), "weights")
    # words for each unit of weight: those that reach their cap at it stay there, and the rest is shared again
    size, open_weight = rows.agg(F.sum("source_size"), F.sum("w")).first()
    total, full, each = share * (size or 0), 0, 0.0
    while open_weight:
        each = max(0.0, total) / open_weight
        capped = F.col("cap") <= F.lit(each) * F.col("w")
        now, taken, open_weight = rows.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        total = share * size - taken
        if now == full:
            break
        full = now
    return rows.select("source", "source_size", "source_rows", F.least("cap", F.lit(each) * F.col("w")).alias("target"))


def _coin(seed: int, key: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) decided by the keys."""
    return (mix64(key.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)) >> np.uint64(11)) * 2.0**-53


def pivot(p: list[float], words: list[float], coins: list[float]) -> tuple[list[int], int]:
    """Rounds fractions to 0 or 1 in order, moving words between two at a time. All but one come out; that one's place (or -1) is the second result and ``p`` at it its fraction."""
    out = [-1] * len(p)
    now = -1
    for j in range(len(p)):
        if p[j] <= _EPS or p[j] >= 1 - _EPS:
            out[j] = int(p[j] > 0.5)
            continue
        if words[j] <= 0:
            out[j] = int(coins[j] < p[j])
            continue
        if now < 0:
            now = j
            continue
        i = now
        up, down = min(words[i] * (1 - p[i]), words[j] * p[j]), min(words[j] * (1 - p[j]), words[i] * p[i])
        moved = up if coins[j] * (up + down) < down else -down
        p[i] += moved / words[i]
        p[j] -= moved / words[j]
        for k in (i, j):
            if p[k] <= _EPS or p[k] >= 1 - _EPS:
                out[k] = int(p[k] > 0.5)
        now = next((k for k in (i, j) if out[k] < 0), -1)
    return out, now


def mix(df: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, size: str = "size", source: str = "source", seed: int = 7, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """``df`` with source_size, target and ``copies`` (int). ``size`` names a long column; ``most`` is a whole number."""
    keep = [c for c in df.columns if c not in ("source_size", "target", "copies")]
    names = [f"_c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), *names)).withColumn("part", F.spark_partition_id())
    kinds = materialise(rows.groupBy("source", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "kinds")
    plan = kinds.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("source_rows"))
    plan = materialise(targets(plan, weights, share, most), "targets")
    copies = F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(float(most))), F.lit(0.0))
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", copies.alias("x"), F.ceil(F.greatest(F.col("source_rows") / block_rows, F.col("source_size") / BLOCK_WORDS)).cast("long").alias("blocks"))
    many = kinds.filter(F.col("n") > block_rows // 8).select("h").distinct()
    rows = _numbered(rows, many) if not many.isEmpty() else rows.withColumn("g", F.lit(0).cast("long"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h", "g"), "blocks"))
    inner = [*names, "source", "size", "source_size", "target", "block", "blocks"]
    schema = T.StructType([*(rows.schema[c] for c in inner), T.StructField("copies", T.IntegerType()), T.StructField("p", T.DoubleType()), T.StructField("h", T.LongType())])

    def first(table: pa.Table) -> pa.Table:
        h = table["h"].to_numpy()
        words = table["size"].to_numpy().astype(float)
        order = np.lexsort((h, -words))  # long ones first: they are settled against the many short ones, and what is left is short
        x = table["x"].to_numpy()
        whole = np.floor(x + _EPS)
        p, whole = (x - whole)[order], whole.astype(int)
        p = p.tolist()
        bits, left = pivot(p, words[order].tolist(), _coin(seed, h[order] + np.arange(len(h)) * 0x632BE5AB).tolist())
        copies = np.empty(len(h), object)
        rest = np.full(len(h), np.nan)
        copies[order] = [b if b >= 0 else None for b in bits]
        if left >= 0:
            rest[order[left]] = p[left]
        made = [None if c is None else int(c + w) for c, w in zip(copies, whole, strict=True)]
        base = [int(w) if c is None else c for c, w in zip(made, whole, strict=True)]
        return pa.table([*(table[c] for c in inner), pa.array(base, pa.int32()), pa.array(rest, pa.float64(), from_pandas=True), table["h"]], names=[f.name for f in schema])

    done = materialise(rows.groupBy("source", "block").applyInArrow(first, schema), "mixed")
    left = done.filter(F.col("p").isNotNull()).select("source", "block", "blocks", F.col("block").alias("node"), "p", F.col("size").cast("double").alias("words"), "h")
    level, decided = 1, None
    tree = T.StructType([rows.schema["source"], *T.StructType.fromDDL(_TREE)])
    most_blocks = plan.agg(F.max("blocks")).first()[0] or 1
    while True:
        last = most_blocks <= 1
        up = materialise(left.withColumn("up", F.floor(F.col("node") / fan).cast("long")).groupBy("source", "up").applyInArrow(_tree_step(seed + level, last), tree), "tree")
        part = up.filter("bit >= 0").select("source", "block", "bit")
        decided = part if decided is None else decided.unionByName(part)
        if last:
            break
        left = up.filter("bit < 0").drop("bit")
        most_blocks = -(-most_blocks // fan)
        level += 1
    bits = decided.select(F.col("source").alias("s"), F.col("block").alias("b"), "bit")
    open_rows = done.filter(F.col("p").isNotNull()).join(bits, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("copies", F.col("copies") + F.col("bit"))
    cols = [*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "source_size", "target", "copies"]
    return done.filter(F.col("p").isNull()).select(*cols).unionByName(open_rows.select(*cols))


def _numbered(rows: DataFrame, many: DataFrame) -> DataFrame:
    """``rows`` with ``g``: a number among the rows of equal h for those in ``many``, 0 for others."""
    equal = materialise(rows.join(many, "h", "left_semi"), "equal")
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = materialise(equal.groupBy("h", "part").agg(F.count("*").alias("n")).select("h", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "firsts")
    place = F.row_number().over(Window.partitionBy("h", "part").orderBy("h"))
    equal = equal.withColumn("place", place).join(first, ["h", "part"]).withColumn("g", F.col("first") + F.col("place")).select(*rows.columns, "g")
    return rows.join(many, "h", "left_anti").withColumn("g", F.lit(0).cast("long")).select(*rows.columns, "g").unionByName(equal)


_TREE = "block long, blocks long, node long, p double, words double, h long, bit int"


def _tree_step(seed: int, last: bool):
    def step(table: pa.Table) -> pa.Table:
        node, p, words = (table[c].to_numpy() for c in ("node", "p", "words"))
        order = np.lexsort((node, -words))
        frac = p[order].tolist()
        coins = _coin(seed, table["h"].to_numpy()[order])
        bits, left = pivot(frac, words[order].tolist(), coins.tolist())
        if left >= 0 and last:
            bits[left] = int(_coin(seed + 1, table["h"].to_numpy()[order[left : left + 1]])[0] < frac[left])
        table = table.take(pa.array(order))
        up = table["up"].to_numpy()
        return pa.table([table["source"], table["block"], table["blocks"], pa.array(up), pa.array(frac), table["words"], table["h"], pa.array(bits, pa.int32())], names=["source", *(x.split()[0] for x in _TREE.split(", "))])

    return step
