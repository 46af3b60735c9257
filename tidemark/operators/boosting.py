"""Boosted regression trees for all symbols at once, grown level by level from histograms.

Features are cut into bins once: a fine histogram of equal cells for each symbol and feature, whose running counts say which cells make a bin of about as
many rows as the others. A level of all symbols' trees is one aggregate of residuals by symbol, node, feature and bin with partial sums, so that a symbol with a third of
all rows is no task of its own, and one search over running sums of bins. Trees are rows of a table; a symbol's tree goes to its rows by a join.
Only the trees of a round and the rows' predictions are written, a round after the other, and a run that is broken off goes on from the last whole round.

Targets, predictions and leaves are whole numbers of ``UNIT``, so that sums don't depend on their order and reruns agree to the last bit. A node is cut where the gain
sl²/(nl + penalty) + sr²/(nr + penalty) − s²/(n + penalty) is greatest and above zero (ties: the least feature, then the least bin) and both sides have ``least`` rows. Rows and
features of a round are drawn by hashes of the day and of the feature, and the seed and round. Rows with a NULL feature or target don't count; a feature without spread has one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import delete, scratch_path

#: Part of one that targets and predictions are counted in, and cells of the fine histograms.
UNIT, CELLS = 1e9, 4096
#: Settings of the two kinds of ensembles: rounds, depth, learning rate, least rows of a leaf, penalty.
XGB = {"rounds": 500, "depth": 6, "rate": 0.05, "least": 1, "penalty": 1.0}
LGBM = {"rounds": 600, "depth": 5, "rate": 0.03, "least": 20, "penalty": 0.0}


def drawn_sql(number: str, salt: int, share: float) -> str:
    """Whether a number is drawn, for a share of all numbers; the salt makes draws differ."""
    return f"((CAST({number} AS BIGINT) * 7919 + {salt} * 104729 + 12289) % 2147483647 * 48271 % 2147483647) % 1000 < {round(share * 1000)}"


def binned(rows: DataFrame, features: list[str], target: str = "y", bins: int = 64) -> DataFrame:
    """(symbol, day, x, y) of ``rows`` (symbol, dt, features, target): bins of the features as an array, day as a number, the target in units."""
    known = rows.dropna(subset=[*features, target]).select("symbol", F.datediff("dt", F.lit("1970-01-01")).cast("long").alias("day"), F.array(*[F.col(f).cast("double") for f in features]).alias("v"), F.round(F.col(target) * UNIT).cast("long").alias("y"))
    spread = known.groupBy("symbol").agg(*[F.array(*[g(F.col("v")[i]) for i in range(len(features))]).alias(n) for n, g in (("low", F.min), ("high", F.max))], F.count("*").alias("n"))
    cell = F.transform("v", lambda x, i: F.when(F.col("high")[i] > F.col("low")[i], F.least(F.floor((x - F.col("low")[i]) / (F.col("high")[i] - F.col("low")[i]) * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int"))
    cells = known.join(spread, "symbol").select("symbol", "day", "y", "n", cell.alias("c"))
    counts = cells.select("symbol", "n", F.posexplode("c").alias("feature", "cell")).groupBy("symbol", "n", "feature", "cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("symbol", "feature").orderBy("cell")) - F.col("rows")
    placed = counts.withColumn("bin", F.floor(before * bins / F.col("n")).cast("int"))
    firsts = placed.groupBy("symbol", "feature", "bin").agg(F.min("cell").alias("cell"))
    edges = firsts.groupBy("symbol", "feature").agg(F.array_sort(F.collect_list(F.struct("cell", "bin"))).alias("e"))
    edges = edges.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("feature", "e"))).alias("edges"))
    found = F.transform("c", lambda x, i: F.element_at(F.filter(F.element_at("edges", i), lambda e: e["cell"] <= x), -1)["bin"])
    return cells.drop("n").join(edges, "symbol").select("symbol", "day", found.alias("x"), "y")


def _walked(depth: int) -> Column:
    """A row's leaf: the node that it comes to in ``tree``, and that node's value."""
    start = F.struct(F.lit(1).alias("node"), F.coalesce("root", F.lit(0)).cast("long").alias("value"))

    def step(at, _):
        cut = F.get(F.col("tree"), at["node"] - 1)
        left = F.get(F.col("x"), cut["feature"]) <= cut["bin"]
        down = F.struct((2 * at["node"] + F.when(left, 0).otherwise(1)).cast("int").alias("node"), F.when(left, cut["lv"]).otherwise(cut["rv"]).alias("value"))
        return F.when(cut["feature"].isNull(), at).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)


def _trees(nodes: DataFrame, depth: int) -> DataFrame:
    """(symbol, root, tree) of rows of nodes: a tree's cuts as an array by number of node."""
    cut = F.struct("feature", "bin", "lv", "rv")
    found = nodes.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("node", cut))).alias("m"), F.max(F.when(F.col("node") == 1, F.col("own"))).alias("root"))
    return found.select("symbol", "root", F.transform(F.sequence(F.lit(1), F.lit(2**depth - 1)), lambda n: F.try_element_at("m", n)).alias("tree"))


def _level(state: DataFrame, so_far: DataFrame | None, level: int, number: int, seed: int, rate: float, least: int, penalty: float, rows_share: float, features_share: float) -> DataFrame:
    """The cuts of one level of all symbols' trees; at the root also those that can't be cut, with the value of all rows."""
    rows = state.filter(drawn_sql("day", seed + number, rows_share)).withColumn("r", F.col("y") - F.col("p"))
    if so_far is None:
        rows = rows.withColumn("node", F.lit(1))
    else:
        rows = rows.join(_trees(so_far, level), "symbol").withColumn("node", _walked(level)["node"]).filter(F.col("node") >= 2**level)
    sums = rows.select("symbol", "node", "r", F.posexplode("x").alias("feature", "bin")).groupBy("symbol", "node", "feature", "bin").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    sums = sums.repartition("symbol", "node")  # a few sums a bin, and one exchange for all that follows
    up, whole = Window.partitionBy("symbol", "node", "feature").orderBy("bin"), Window.partitionBy("symbol", "node", "feature")
    runs = sums.select("symbol", "node", "feature", "bin", F.sum("s").over(up).alias("sl"), F.sum("n").over(up).alias("nl"), F.sum("s").over(whole).alias("s"), F.sum("n").over(whole).alias("n"))

    def part(s, n):
        return F.try_divide(s.cast("double") * s.cast("double"), n.cast("double") + F.lit(penalty))

    sl, nl, s, n = map(F.col, ("sl", "nl", "s", "n"))
    gain = part(sl, nl) + part(s - sl, n - nl) - part(s, n)
    may = (nl >= least) & (n - nl >= least) & (gain > 0) & F.expr(drawn_sql("feature", seed + 31 * number + 7, features_share))
    best = runs.withColumn("gain", F.when(may, gain)).groupBy("symbol", "node").agg(
        F.max(F.when(F.col("gain").isNotNull(), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "sl", "nl"))).alias("c"), F.max("s").alias("s"), F.max("n").alias("n")
    )

    def value(s, n):
        return F.coalesce(F.round(F.try_divide(s.cast("double") * F.lit(rate), n.cast("double") + F.lit(penalty))), F.lit(0.0)).cast("long")

    c = F.col("c")
    out = best.select("symbol", "node", (-c["f"]).alias("feature"), (-c["b"]).alias("bin"), F.when(c.isNotNull(), value(c["sl"], c["nl"])).alias("lv"), F.when(c.isNotNull(), value(s - c["sl"], n - c["nl"])).alias("rv"), value(s, n).alias("own"), F.lit(number).alias("number"))
    return out.filter((F.col("node") == 1) | F.col("feature").isNotNull())


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_boosted(
    table: DataFrame, rounds: int = 500, depth: int = 6, rate: float = 0.05, least: int = 1, penalty: float = 1.0, rows_share: float = 0.8, features_share: float = 0.8, seed: int = 42, min_rows: int = 100, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ensembles for every symbol of ``table`` (as ``binned`` makes it) with more than ``min_rows`` rows: (trees, fitted).

    trees: symbol, number (of the round, from 1; 0 is the base, the mean), node, feature, bin, lv, rv (what rows up to the bin and above it get), own (of the root as a leaf). fitted: symbol, day, x, y, p. A ``folder`` of an earlier run
    over the same table and settings is gone on with; rounds that it has aren't grown again."""
    spark = table.sparkSession
    folder = folder or scratch_path(spark, "boosting")
    if not _there(spark, f"{folder}/fitted/0"):
        means = table.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("y").alias("s")).filter(F.col("n") > min_rows).select("symbol", F.round(F.col("s") / F.col("n")).cast("long").alias("p"))
        _kept(means.select("symbol", F.lit(1).alias("node"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("lv"), F.lit(None).cast("long").alias("rv"), F.col("p").alias("own"), F.lit(0).alias("number")), f"{folder}/trees/0")
        _kept(table.join(means, "symbol"), f"{folder}/fitted/0")
    done = max(k for k in range(rounds + 1) if _there(spark, f"{folder}/fitted/{k}"))
    state = spark.read.parquet(f"{folder}/fitted/{done}")
    for number in range(done + 1, rounds + 1):
        nodes = None
        for level in range(depth):
            part = f"{folder}/levels/{number}-{level}"
            cut = _kept(_level(state, nodes, level, number, seed, rate, least, penalty, rows_share, features_share), part)
            nodes = cut if nodes is None else nodes.unionByName(cut)
        trees = _kept(nodes.coalesce(1), f"{folder}/trees/{number}")
        moved = state.join(_trees(trees, depth), "symbol").withColumn("p", F.col("p") + _walked(depth)["value"]).select("symbol", "day", "x", "y", "p")
        state = _kept(moved, f"{folder}/fitted/{number}")
        for level in range(depth):
            delete(spark, f"{folder}/levels/{number}-{level}")
        delete(spark, f"{folder}/fitted/{number - 2}" if number > 2 else f"{folder}/levels")
    return spark.read.parquet(*[f"{folder}/trees/{k}" for k in range(rounds + 1)]), state


def predict_boosted(table: DataFrame, trees: DataFrame, depth: int = 6, together: int = 16) -> DataFrame:
    """``table`` (symbol, day, x) with ``prediction``. A symbol's trees go to its rows ``together`` at a time, and their values are summed."""
    base = trees.filter("number = 0").select("symbol", F.col("own").alias("base"))
    cut = F.struct("feature", "bin", "lv", "rv")
    each = trees.filter("number > 0").groupBy("symbol", "number").agg(F.map_from_entries(F.collect_list(F.struct("node", cut))).alias("m"), F.max(F.when(F.col("node") == 1, F.col("own"))).alias("root"))
    blocks = each.groupBy("symbol", F.floor(F.col("number") / together).alias("block")).agg(F.collect_list(F.struct("m", "root")).alias("trees"))

    def leaf(t):
        start = F.struct(F.lit(1).alias("node"), t["root"].alias("value"))

        def step(at, _):
            c = F.try_element_at(t["m"], at["node"])
            left = F.get(F.col("x"), c["feature"]) <= c["bin"]
            return F.when(c["feature"].isNull(), at).otherwise(F.struct((2 * at["node"] + F.when(left, 0).otherwise(1)).cast("int").alias("node"), F.when(left, c["lv"]).otherwise(c["rv"]).alias("value")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)["value"]

    voted = table.join(blocks, "symbol").select("symbol", "day", F.aggregate(F.transform("trees", leaf), F.lit(0).cast("long"), lambda a, b: a + b).alias("v"))
    total = voted.groupBy("symbol", "day").agg(F.sum("v").alias("v"))
    return table.join(base, "symbol").join(total, ["symbol", "day"], "left").withColumn("prediction", (F.col("base") + F.coalesce("v", F.lit(0))) / UNIT).drop("base", "v")


def boosted_sql(table: str, n_features: int, rounds: int, depth: int, rate: float, least: int = 1, penalty: float = 1.0, rows_share: float = 0.8, features_share: float = 0.8, seed: int = 42, min_rows: int = 100, bins: int = 64) -> str:
    """CTEs that grow the same ensembles over the CTE ``table`` (symbol, day, v: list of doubles, y: units); ``fitted{rounds}`` has symbol, day, p, ``trees`` the cuts."""
    part = lambda s, n: f"CAST({s} AS DOUBLE) * CAST({s} AS DOUBLE) / nullif(CAST({n} AS DOUBLE) + {penalty}, 0)"
    value = lambda s, n: f"CAST(coalesce(round(CAST({s} AS DOUBLE) * {rate} / nullif(CAST({n} AS DOUBLE) + {penalty}, 0)), 0) AS BIGINT)"
    out = [
        f"long0 AS MATERIALIZED (SELECT symbol, day, y, unnest(range({n_features})) AS feature, unnest(v) AS v FROM {table})",
        "spread AS MATERIALIZED (SELECT symbol, feature, min(v) AS low, max(v) AS high, count(*) AS n FROM long0 GROUP BY symbol, feature)",
        f"cells AS MATERIALIZED (SELECT l.*, s.n, CASE WHEN high > low THEN least(CAST(floor((v - low) / (high - low) * {CELLS}) AS BIGINT), {CELLS - 1}) ELSE 0 END AS cell FROM long0 l JOIN spread s USING (symbol, feature))",
        f"placed AS MATERIALIZED (SELECT symbol, feature, cell, CAST(floor((sum(rows) OVER (PARTITION BY symbol, feature ORDER BY cell) - rows) * {bins} / CAST(n AS DOUBLE)) AS BIGINT) AS bin FROM (SELECT symbol, feature, cell, n, count(*) AS rows FROM cells GROUP BY ALL))",
        "x AS MATERIALIZED (SELECT c.symbol, c.day, c.y, c.feature, p.bin FROM cells c JOIN placed p USING (symbol, feature, cell))",
        f"fitted0 AS MATERIALIZED (SELECT symbol, day, y, m AS p FROM (SELECT DISTINCT symbol, day, y FROM x) JOIN (SELECT symbol, CAST(round(sum(y) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM {table} GROUP BY symbol HAVING count(*) > {min_rows}) USING (symbol))",
    ]
    trees = []
    for k in range(1, rounds + 1):
        out.append(f"n{k}_0 AS MATERIALIZED (SELECT symbol, day, y, p, 1 AS node, CAST(0 AS BIGINT) AS v FROM fitted{k - 1})")
        for d in range(depth):
            out += [
                f"h{k}_{d} AS MATERIALIZED (SELECT symbol, node, feature, bin, CAST(sum(y - p) AS BIGINT) AS s, count(*) AS n FROM n{k}_{d} JOIN x USING (symbol, day, y) WHERE node >= {2**d} AND {drawn_sql('day', seed + k, rows_share)} GROUP BY ALL)",
                f"r{k}_{d} AS MATERIALIZED (SELECT symbol, node, feature, bin, CAST(sum(s) OVER u AS BIGINT) AS sl, CAST(sum(n) OVER u AS BIGINT) AS nl, CAST(sum(s) OVER w AS BIGINT) AS s, CAST(sum(n) OVER w AS BIGINT) AS n FROM h{k}_{d} WINDOW u AS (PARTITION BY symbol, node, feature ORDER BY bin), w AS (PARTITION BY symbol, node, feature))",
                f"g{k}_{d} AS MATERIALIZED (SELECT *, CASE WHEN nl >= {least} AND n - nl >= {least} AND {drawn_sql('feature', seed + 31 * k + 7, features_share)} THEN {part('sl', 'nl')} + {part('(s - sl)', '(n - nl)')} - {part('s', 'n')} END AS gain FROM r{k}_{d})",
                f"c{k}_{d} AS MATERIALIZED (SELECT symbol, node, s, n, feature, bin, sl, nl, gain > 0 AS cut FROM g{k}_{d} QUALIFY row_number() OVER (PARTITION BY symbol, node ORDER BY CASE WHEN gain > 0 THEN gain END DESC NULLS LAST, feature, bin) = 1)",
                f"t{k}_{d} AS MATERIALIZED (SELECT symbol, {k} AS number, node, CASE WHEN cut THEN feature END AS feature, CASE WHEN cut THEN bin END AS bin, CASE WHEN cut THEN {value('sl', 'nl')} END AS lv, CASE WHEN cut THEN {value('(s - sl)', '(n - nl)')} END AS rv, {value('s', 'n')} AS own FROM c{k}_{d} WHERE node = 1 OR cut)",
                f"n{k}_{d + 1} AS MATERIALIZED (SELECT a.symbol, a.day, a.y, a.p, CASE WHEN t.feature IS NULL THEN a.node WHEN x.bin <= t.bin THEN 2 * a.node ELSE 2 * a.node + 1 END AS node, CASE WHEN t.feature IS NULL THEN coalesce(CASE WHEN a.node = 1 THEN t.own END, a.v) WHEN x.bin <= t.bin THEN t.lv ELSE t.rv END AS v FROM n{k}_{d} a LEFT JOIN t{k}_{d} t ON t.symbol = a.symbol AND t.node = a.node LEFT JOIN x ON x.symbol = a.symbol AND x.day = a.day AND x.feature = t.feature)",
            ]
            trees.append(f"SELECT * FROM t{k}_{d}")
        out.append(f"fitted{k} AS MATERIALIZED (SELECT symbol, day, y, p + v AS p FROM n{k}_{depth})")
    out.append(f"trees AS ({' UNION ALL '.join(trees)})")
    return ", ".join(out)
