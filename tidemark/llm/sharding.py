"""A uniform shuffle of rows into shards of exact sizes through a hypergeometric communication matrix, in SQL expressions.

1. Each row gets its input partition and two random keys, hashes of the seed, the purpose (leaving the partition or arriving in the
   shard) and the row's place, so that no key of one partition or purpose tells of another. These rows are written once, so that all
   later steps, reruns of lost tasks included, see the same ones.
2. The matrix of how many rows each partition sends to each shard is drawn exactly as a uniform shuffle would make it: row by
   row, each entry is hypergeometric given the entries before it. Partitions are grouped by ``FAN``; first the groups' rows of
   the matrix are drawn, then, for all groups at once, those of their partitions.
3. Each partition permutes its rows and sends off the counts drawn; each shard permutes what it gets. A shard's permutation is by
   ranges of the second random key, whose row counts give each range's first slot, so that no shard is sorted in one task.

Shard sizes are at most one apart. An entry is drawn by sequential choice for up to 16 rows, else by the ratio-of-uniforms
rejection method for the hypergeometric distribution, with uniforms from hashes of the seed and the entry's place. A try is accepted in more
than half of all cases, so that all ``TRIES`` fail, and the mode is taken, with a chance below 2**-64; else the law is exact but for the hashes.

All columns of the input are kept, but for those named ``shard`` and ``slot``, which are replaced. Nulls in any column, repeated
rows and ties are rows like any others. An empty table gives an empty one. One value of any column may hold any share of
the rows: nothing is dealt by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Partitions whose rows of the matrix are drawn in one task; rows of a shard that are sorted at a time; tries of the rejection method.
FAN, RANGE_ROWS, TRIES = 512, 250_000, 64
#: Most rows that are drawn one by one.
FEW = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that the key decides."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12) + F.lit(0.5)) * F.lit(2.0**-52)


def _log_factorial(n: Column) -> Column:
    x = n + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(n < 16, F.element_at(table, n.cast("int") + 1)).otherwise(series)


def _few(good: Column, total: Column, sample: Column, key: tuple[Column, ...]) -> Column:
    """Draws one row after another."""
    start = F.struct(good.cast("long").alias("good"), total.cast("long").alias("total"), F.lit(0).cast("long").alias("got"))

    def step(acc: Column, i: Column) -> Column:
        hit = (_uniform(*key, i) * acc["total"] < acc["good"]).cast("long")
        return F.struct((acc["good"] - hit).alias("good"), (acc["total"] - 1).alias("total"), (acc["got"] + hit).alias("got"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), sample.cast("long")), start, step, lambda acc: acc["got"])


def _many(good: Column, total: Column, sample: Column, key: tuple[Column, ...]) -> Column:
    """Ratio of uniforms: a point under a table mountain over the distribution, accepted by the exact density. ``good`` and ``sample`` are at most half of ``total``."""
    n, m, big = good.cast("double"), sample.cast("double"), total.cast("double")
    share = n / big
    spread = F.sqrt((big - m) * m * share * (1 - share) / (big - 1) + 0.5)
    mode = F.floor((m + 1) * (n + 1) / (big + 2)).cast("double")

    def density(k: Column, p: Column) -> Column:
        return _log_factorial(k) + _log_factorial(p["n"] - k) + _log_factorial(p["m"] - k) + _log_factorial(p["big"] - p["n"] - p["m"] + k)

    first = F.struct(n.alias("n"), m.alias("m"), big.alias("big"), (m * share + 0.5).alias("mid"), spread.alias("spread"), mode.alias("mode"))

    def tried(p: Column) -> Column:
        width = p["spread"] * (2 * math.sqrt(2 / math.e)) + (3 - 2 * math.sqrt(3 / math.e))
        most = F.least(F.least(p["n"], p["m"]) + 1, F.floor(p["mid"] + 16 * p["spread"]).cast("double"))

        def step(acc: Column, i: Column) -> Column:
            def place(u: Column) -> Column:
                x = p["mid"] + width * (_uniform(*key, i, F.lit(1)) - 0.5) / u
                return F.when((x >= 0) & (x < most), _let(F.floor(x).cast("double"), lambda k: F.when(2 * F.ln(u) <= density(p["mode"], p) - density(k, p), k)))

            return F.when(acc.isNotNull(), acc).otherwise(_let(_uniform(*key, i, F.lit(0)), place))

        return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), step), p["mode"]).cast("long")

    return _let(first, tried)


def hypergeometric(good: Column, bad: Column, sample: Column, *key: Column) -> Column:
    """Good ones among ``sample`` drawn of ``good`` + ``bad`` (longs; exact in distribution, decided by the key)."""
    args = F.struct(good.cast("long").alias("good"), bad.cast("long").alias("bad"), sample.cast("long").alias("sample"))

    def drawn(a: Column) -> Column:
        total = a["good"] + a["bad"]
        fewer, part = F.least(a["good"], a["bad"]), F.least(a["sample"], total - a["sample"])

        def back(k: Column) -> Column:
            among = F.when(a["good"] > a["bad"], part - k).otherwise(k)
            return F.when(part < a["sample"], a["good"] - among).otherwise(among)

        core = F.when((part <= 0) | (fewer <= 0), F.lit(0).cast("long")).when(part <= FEW, _few(fewer, total, part, key)).when(fewer <= FEW, _few(part, total, fewer, key)).otherwise(_many(fewer, total, part, key))
        return _let(core, back)

    return _let(args, drawn)


def _row(capacity: Column, sample: Column, *key: Column) -> Column:
    """One row of the matrix: how ``sample`` rows fall into shards that have ``capacity`` (array) places left."""
    total = F.aggregate(capacity, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("total"), sample.cast("long").alias("left"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        room = F.element_at(capacity, i)
        drawn = hypergeometric(room, acc["total"] - room, acc["left"], *key, i)
        return _let(drawn, lambda k: F.struct((acc["total"] - room).alias("total"), (acc["left"] - k).alias("left"), F.concat(acc["out"], F.array(k)).alias("out")))

    return F.aggregate(F.sequence(F.lit(1), F.size(capacity)), start, step, lambda acc: acc["out"])


def _rows(capacity: Column, parts: Column, *key: Column) -> Column:
    """Rows of the matrix for ``parts`` (array of id, n), one after another, as array of (id, out)."""
    start = F.struct(capacity.alias("room"), F.array().cast("array<struct<id:long,out:array<long>>>").alias("rows"))

    def step(acc: Column, part: Column) -> Column:
        def put(out: Column) -> Column:
            left = F.zip_with(acc["room"], out, lambda a, b: a - b)
            return F.struct(left.alias("room"), F.concat(acc["rows"], F.array(F.struct(part["id"].alias("id"), out.alias("out")))).alias("rows"))

        return _let(_row(acc["room"], part["n"], *key, part["id"]), put)

    return F.aggregate(parts, start, step, lambda acc: acc["rows"])


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int = 0, fan: int = FAN) -> DataFrame:
    """``counts`` (id long, n long: rows of each partition) and shard sizes (of the same sum) to (id, out: array of rows for each shard)."""
    counts = counts.select(F.col("id").cast("long").alias("id"), F.col("n").cast("long").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("id", "n")))
    groups = counts.withColumn("g", F.floor(F.col("id") / fan)).groupBy("g").agg(F.sum("n").alias("n"), pairs.alias("parts"))
    tops = groups.select(F.col("g").alias("id"), "n").agg(pairs.alias("parts"))
    room = F.array(*[F.lit(n).cast("long") for n in sizes])
    tops = tops.select(F.explode(_rows(room, F.col("parts"), F.lit(seed), F.lit("groups"))).alias("r")).select(F.col("r.id").alias("g"), F.col("r.out").alias("room"))
    return groups.join(tops, "g").select(F.explode(_rows(F.col("room"), F.col("parts"), F.lit(seed), F.lit("parts"))).alias("r")).select("r.id", "r.out")


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard)."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    names = [f"_c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.spark_partition_id().cast("long").alias("id"), F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumns({"leave": F.xxhash64(F.lit(seed), F.lit("leave"), "at"), "arrive": F.xxhash64(F.lit(seed), F.lit("arrive"), "at")})
    rows = materialise(rows, "shuffled")
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    total = rows.count()
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    sent = communication_matrix(counts, sizes, seed)
    upto = F.transform(F.sequence(F.lit(1), F.size("out")), lambda i: F.aggregate(F.slice("out", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    sent = materialise(sent.select("id", upto.alias("upto")), "matrix")
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("leave", "at")))
    dealt = local.join(sent, "id").withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("rank"))))
    ranges = max(1, -(-total // (n_shards * RANGE_ROWS)))
    dealt = materialise(dealt.select(*names, "shard", "arrive", "at", F.floor(F.shiftrightunsigned("arrive", 12) * F.lit(2.0**-52) * ranges).cast("int").alias("part")), "dealt")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.shiftrightunsigned("arrive", 12), "arrive", "at")))
    slot = (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")
    return placed.join(first, ["shard", "part"]).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "shard", slot)
