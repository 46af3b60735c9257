"""Registry of the engine's queries over the supplied tables, each with the same in DuckDB SQL where SQL can say it.

Doubles are rounded to four places on both sides, dates are text, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.library import GROUPS
from tidemark.functions.indicators import FAMILIES, OF_A_FAMILY
from tidemark.operators import backtest, boosting, clean, features as feat, fits, joins, mapping, models, resample, scans, signals, splits, training, walkforward
from tidemark.sources import fetching, fixtures as fx, readers, scratch, sinks, versions
from tidemark.sources.scratch import scratch_path
from tidemark.streaming import incremental, running
from tidemark.streaming.incremental import bars_of_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BARS = f"WITH bars AS MATERIALIZED ({fx.BARS_SQL})"
INDEXED = f"SELECT b.symbol, b.dt, b.Open, b.High, b.Low, b.Close, b.Volume, i.Market, i.Sector FROM bars b LEFT JOIN ({fx.INDEX_SQL}) i ON b.dt = i.dt"
#: Columns of great size, which are compared by their logarithm, or as whole numbers.
COARSE, WHOLE = ("Signal_Stability", "State_Edge_Stability"), ("Ease_Of_Movement", "Payoff_Ratio_Given_Ecosystem_State")
#: Added before rounding: products of simple fractions lie on halves of the last place, which sums in another order would round either way.
NUDGE = 3e-8


def rounded(name: str) -> Column:
    return (F.round(F.col(name), 4) + F.lit(0.0)).alias(name)


def _r(df: DataFrame, *columns: str) -> list:
    kinds = dict(df.dtypes)
    return [rounded(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) if kinds[c] in ("date", "timestamp") else F.col(c) for c in (columns or df.columns)]


def _tidy(df: DataFrame) -> DataFrame:
    return df.select(*_r(df))


def add(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return keep


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.bars_daily(spark, sf_dir)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.with_indices(_daily(spark, sf_dir))


def _doubles(names: list[str]) -> str:
    return ", ".join(f"round({n}, 4) + 0e0 AS {n}" for n in names)


# -- bars ----------------------------------------------------------------------------------------------------------------------

_BAR = ["Open", "High", "Low", "Close", "Volume"]
add("bars_daily", f"SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_doubles(_BAR)} FROM ({fx.BARS_SQL})")(lambda s, d: _tidy(_daily(s, d)))
add("bars_hourly", f"SELECT symbol, strftime(dt, '%Y-%m-%d %H:%M:%S') AS dt, {_doubles(_BAR)} FROM ({fx.HOURLY_SQL})")(lambda s, d: _tidy(fx.bars_hourly(s, d)))
add("events_window_bars", f"SELECT symbol, strftime(dt, '%Y-%m-%d %H:%M:%S') AS dt, {_doubles(_BAR)} FROM ({fx.HOURLY_SQL})")(lambda s, d: _tidy(bars_of_events(fx.table(s, d, "events"))))
for _p in resample.PERIOD_END:
    add(f"{_p}_resample", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_doubles(_BAR)} FROM ({resample.resample_sql('SELECT * FROM bars', _p)})")(lambda s, d, p=_p: _tidy(resample.resample(_daily(s, d), p)))
add("asof_coarse", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_doubles(feat.COARSE_COLUMNS)} FROM ({resample.with_coarse_sql('SELECT * FROM bars', ['symbol', 'dt', *_BAR])})")(
    lambda s, d: _tidy(resample.with_coarse(_daily(s, d)).select("symbol", "dt", *feat.COARSE_COLUMNS))
)


# -- indicators ----------------------------------------------------------------------------------------------------------------


def _short(df: DataFrame, names: list[str]) -> list[Column]:
    def one(n: str) -> Column:
        if n.endswith(COARSE):
            return F.round(F.ln(n) + NUDGE, 4)
        return F.round(F.col(n) + NUDGE, 0 if n in WHOLE else 4)

    return [(one(n) + F.lit(0.0)).alias(n) for n in names]


def _short_sql(names: list[str]) -> str:
    return ", ".join(f"round({f'ln({n})' if n.endswith(COARSE) else n} + {NUDGE}, {0 if n in WHOLE else 4}) + 0e0 AS {n}" for n in names)


def _features(name: str, names: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = feat.features(_indexed(spark, sf_dir), names)
        return df.select("symbol", F.col("dt").cast("string").alias("dt"), *_short(df, names))

    add(name, f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_short_sql(names)} FROM ({feat.features_sql(INDEXED, names)})")(run)


for _group, _formulas in GROUPS.items():
    if _group != "family_statistics":
        _features(f"ind_{_group}", list(_formulas))
for _f in FAMILIES:
    _features(f"family_{_f.lower()}", [f"{_f}_{x}" for x in OF_A_FAMILY])

_STATE = list(feat.STATE_FORMULAS)


@add("state_probabilities", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, Ecosystem_State_ID, {_short_sql(_STATE)} FROM ({feat.state_probabilities_sql(INDEXED, _STATE)})")
def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = feat.state_probabilities(_indexed(spark, sf_dir), _STATE)
    return df.select("symbol", F.col("dt").cast("string").alias("dt"), "Ecosystem_State_ID", *_short(df, _STATE))


# -- cleaning ------------------------------------------------------------------------------------------------------------------


@add("clean_numeric", "SELECT o_orderkey, round(o_totalprice, 2) + 0e0 AS price, round(o_totalprice / 1e3, 1) + 0e0 AS pct, CAST(NULL AS DOUBLE) AS bad FROM orders")
def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text with thousands separators, shares with a sign of percent, and text that is no number."""
    price = F.format_number(F.round("o_totalprice", 2), 2)
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"), F.concat(F.round(F.col("o_totalprice") / 1e3, 1).cast("string"), F.lit("%")).alias("pct"), F.col("o_orderpriority").alias("bad"))
    return _tidy(clean.clean_numbers(rows, ["price", "pct", "bad"]))


@add("fill_both_ways", f"""{BARS}, gappy AS (SELECT symbol, dt, CASE WHEN Volume > 1e0 THEN Close END AS x FROM bars)
    SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING),
    first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) + 0e0 AS x FROM gappy""")
def _fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _daily(spark, sf_dir).select("symbol", "dt", F.when(F.col("Volume") > 1, F.col("Close")).alias("x"))
    return _tidy(clean.fill(rows, ["x"]))


@add("stage_windows", f"{BARS} " + " UNION ALL ".join(
    f"SELECT '{s}' AS stage, symbol, count(*) AS n, CAST(min(dt) AS VARCHAR) AS first FROM bars WHERE dt <= DATE '2000-06-30'{'' if s == 'yearly' else f' AND dt >= DATE {chr(39)}2000-06-30{chr(39)} - {clean.STAGE_DAYS[s]}'} GROUP BY symbol" for s in ("yearly", "monthly", "weekly", "daily")))
def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _daily(spark, sf_dir)
    parts = [clean.stage_window(bars, s, "2000-06-30").groupBy("symbol").agg(F.count("*").alias("n"), F.min("dt").cast("string").alias("first")).select(F.lit(s).alias("stage"), "symbol", "n", "first") for s in ("yearly", "monthly", "weekly", "daily")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


add("min_history", f"{BARS} SELECT symbol, count(*) AS n FROM bars GROUP BY symbol HAVING count(*) >= 1700")(lambda s, d: clean.with_history(_daily(s, d), 1700).groupBy("symbol").agg(F.count("*").alias("n")))
add("latest_date", "SELECT CAST(greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(ts AS DATE)) FROM events)) AS VARCHAR) AS latest")(
    lambda s, d: clean.latest_date(fx.table(s, d, "orders").select(F.to_date("o_orderdate").alias("dt")), fx.table(s, d, "events").select(F.to_date("ts").alias("dt"))).select(F.col("latest").cast("string"))
)
add("next_business_day", f"{BARS} SELECT DISTINCT CAST(dt AS VARCHAR) AS dt, CAST(dt + CASE isodow(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS VARCHAR) AS next FROM bars")(
    lambda s, d: _daily(s, d).select("dt").distinct().select(F.col("dt").cast("string").alias("dt"), clean.next_business_day(F.col("dt")).cast("string").alias("next"))
)
add("ipo_recent", f"{BARS} SELECT symbol, CAST(min(dt) AS VARCHAR) AS listed, CASE WHEN count(DISTINCT dt) < 2 OR date_diff('day', min(dt), DATE '1996-06-01') < 730 THEN 1e0 ELSE 0e0 END AS IPO_Recent_Flag FROM bars GROUP BY symbol")(
    lambda s, d: _tidy(feat.ipo_recent(_daily(s, d), "1996-06-01"))
)


# -- mapping -------------------------------------------------------------------------------------------------------------------

add("sector_keyword_map", f"SELECT p_partkey, {mapping.sector_of_sql('p_type', 'p_name')} AS sector FROM part")(lambda s, d: fx.table(s, d, "part").select("p_partkey", mapping.sector_of(F.col("p_type"), F.col("p_name")).alias("sector")))
add("sector_index_map", f"SELECT c_custkey, {mapping.index_of_sql('c_mktsegment', 'c_name')} AS idx FROM customer")(lambda s, d: fx.table(s, d, "customer").select("c_custkey", mapping.index_of(F.col("c_mktsegment"), F.col("c_name")).alias("idx")))
add("cap_map", "SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 'NIFTY_MIDCAP' WHEN c_acctbal * 1e8 / 1e7 > 1e5 THEN 'NIFTY_LARGECAP' WHEN c_acctbal * 1e8 / 1e7 > 5e4 THEN 'NIFTY_MIDCAP' ELSE 'NIFTY_SMALLCAP' END AS cap FROM customer")(
    lambda s, d: fx.table(s, d, "customer").select("c_custkey", mapping.cap_index(F.col("c_acctbal") * 1e8).alias("cap"))
)
_VOL_SQL = """(SELECT symbol, CASE WHEN count(r) < 20 THEN 3e-1 ELSE least(greatest(stddev_samp(r) * sqrt(252e0), 5e-2), 1.5e0) END AS annual_vol FROM (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS k FROM
    (SELECT symbol, dt, ln(Close / lag(Close) OVER (PARTITION BY symbol ORDER BY dt)) AS r FROM bars) WHERE r IS NOT NULL) WHERE k <= 252 GROUP BY symbol)"""


@add("volatility_buckets", f"""{BARS} SELECT symbol, round(annual_vol, 4) + 0e0 AS annual_vol, {mapping.level_of_sql('annual_vol')} AS level, {mapping.sector_of_sql('symbol', "''")} AS sector,
    {mapping.bucket_number_sql(f"({mapping.level_of_sql('annual_vol')})", f"({mapping.sector_of_sql('symbol', chr(39) * 2)})")} AS bucket FROM {_VOL_SQL}""")
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.annual_volatility(_daily(spark, sf_dir)).withColumn("level", mapping.level_of(F.col("annual_vol"))).withColumn("sector", mapping.sector_of(F.col("symbol"), F.lit("")))
    return _tidy(rows.withColumn("bucket", mapping.bucket_number(F.col("level"), F.col("sector"))))


@add("merge_small_buckets", f"""WITH m AS (SELECT c_custkey, {mapping.level_of_sql('abs(c_acctbal) / 1e4')} AS level, CAST(c_nationkey AS VARCHAR) AS sector FROM customer)
    SELECT level, CASE WHEN n < 20 THEN 'GENERIC' ELSE sector END AS sector, count(*) AS members FROM (SELECT *, count(*) OVER (PARTITION BY level, sector) AS n FROM m) GROUP BY ALL""")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "customer").select(mapping.level_of(F.abs("c_acctbal") / 1e4).alias("level"), F.col("c_nationkey").cast("string").alias("sector"))
    return mapping.merge_small(rows).groupBy("level", "sector").agg(F.count("*").alias("members"))


# -- joins ---------------------------------------------------------------------------------------------------------------------


def _long_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices that aren't published on Wednesdays."""
    bars = _daily(spark, sf_dir)
    means = bars.groupBy("dt").agg(F.avg("Close").alias("NIFTY50"), F.avg("High").alias("SENSEX"), F.avg("Low").alias("NIFTY_AUTO"))
    return means.select("dt", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("NIFTY50", "SENSEX", "NIFTY_AUTO"))), F.array("NIFTY50", "SENSEX", "NIFTY_AUTO"))).alias("name", "close")).filter("dayofweek(dt) <> 4")


@add("integrate_indices", f"""{BARS}, means AS (SELECT dt, avg(Close) AS a, avg(High) AS b, avg(Low) AS c FROM bars WHERE isodow(dt) <> 3 GROUP BY dt),
    j AS (SELECT b.symbol, b.dt, b.Close, m.a AS NIFTY50, m.b AS SENSEX, CASE WHEN {mapping.index_of_sql('b.symbol', "''")} = 'NIFTY_AUTO' THEN m.c WHEN {mapping.index_of_sql('b.symbol', "''")} = 'NIFTY50' THEN m.a END AS sector_index_value FROM bars b LEFT JOIN means m ON b.dt = m.dt),
    f AS (SELECT symbol, dt, Close, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}' for c in ('NIFTY50', 'SENSEX', 'sector_index_value'))} FROM j)
    SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_doubles(['NIFTY50', 'SENSEX', 'sector_index_value'])}, round(ln(NIFTY50), 4) + 0e0 AS log_NIFTY50, round(ln(sector_index_value), 4) + 0e0 AS log_sector_index_value,
    round(coalesce((Close / lag(Close) OVER (PARTITION BY symbol ORDER BY dt) - 1) * 100, 0e0), 4) + 0e0 AS close_pct_change FROM f""")
def _integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _daily(spark, sf_dir).withColumn("sector_index_name", mapping.index_of(F.col("symbol"), F.lit("")))
    out = joins.integrate(bars, _long_indices(spark, sf_dir))
    return _tidy(out.select("symbol", "dt", "NIFTY50", "SENSEX", "sector_index_value", "log_NIFTY50", "log_sector_index_value", "close_pct_change"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@add("index_outer_fold", f"{BARS} SELECT CAST(dt AS VARCHAR) AS dt, {', '.join(f'round(max(CASE WHEN symbol = {chr(39)}{n}{chr(39)} THEN Close END), 4) + 0e0 AS {n}' for n in _SEGMENTS)} FROM bars GROUP BY dt")
def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(joins.fold(_daily(spark, sf_dir).select("dt", F.col("symbol").alias("name"), F.col("Close").alias("close")), list(_SEGMENTS)))


@add("pending_and_finished", """SELECT c_custkey AS symbol, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'finished' ELSE 'pending' END AS state FROM customer""")
def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, done = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol")), fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol")).distinct()
    return joins.pending(symbols, done).withColumn("state", F.lit("pending")).unionByName(joins.finished(symbols, done).withColumn("state", F.lit("finished")))


@add("upsert_keep_last", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(CASE WHEN dt >= DATE '1999-01-01' THEN Close * 2 ELSE Close END, 4) + 0e0 AS Close FROM bars")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _daily(spark, sf_dir).select("symbol", "dt", "Close")
    new = old.filter("dt >= '1999-01-01'").withColumn("Close", F.col("Close") * 2)
    return _tidy(joins.upsert(old.filter("dt < '2000-01-01'"), new, ["symbol", "dt"]))


@add("checkpoint_priority", """WITH reg AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS symbol, o_custkey % 7 AS bucket, ['daily', 'weekly', 'monthly', 'yearly'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS stage, CAST(o_orderdate AS DATE) AS cutoff, CAST(o_orderkey AS VARCHAR) AS path FROM orders),
    want AS (SELECT c_custkey AS symbol, c_custkey % 7 AS bucket FROM customer),
    found AS (SELECT w.symbol, w.bucket, r.stage, r.cutoff, r.path, 0 AS lv FROM want w JOIN reg r ON r.symbol = w.symbol UNION ALL SELECT w.symbol, w.bucket, r.stage, r.cutoff, r.path, 1 FROM want w JOIN reg r ON r.symbol IS NULL AND r.bucket = w.bucket)
    SELECT symbol, bucket, stage, CAST(cutoff AS VARCHAR) AS cutoff, path FROM (SELECT *, row_number() OVER (PARTITION BY symbol, bucket ORDER BY list_position(['daily', 'weekly', 'monthly', 'yearly'], stage), cutoff DESC, lv, path) AS k FROM found) WHERE k = 1""")
def _checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    stage = F.element_at(F.array(*map(F.lit, joins.STAGES)), (F.col("o_orderkey") % 4).cast("int") + 1)
    registry = orders.select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("symbol"), (F.col("o_custkey") % 7).alias("bucket"), stage.alias("stage"), F.to_date("o_orderdate").alias("cutoff"), F.col("o_orderkey").cast("string").alias("path"))
    wanted = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), (F.col("c_custkey") % 7).alias("bucket"))
    return _tidy(joins.best_checkpoint(wanted, registry))


# -- sequences and splits ------------------------------------------------------------------------------------------------------

_RET = "SELECT symbol, dt, Open, High, Low, Close, Volume, ln(Close / lag(Close) OVER (PARTITION BY symbol ORDER BY dt)) AS LogRet FROM bars"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).withColumn("LogRet", F.ln(F.try_divide(F.col("Close"), F.lag("Close").over(splits.series()))))


@add("sequences", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, i, len(s) AS n, round(list_sum(s), 2) + 0e0 AS total, round(s[1], 2) + 0e0 AS oldest FROM (SELECT symbol, dt, row_number() OVER w - 1 AS i, list(Volume) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WHERE i >= 90")
def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = splits.sequences(_daily(spark, sf_dir), ["Volume"], 90)
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0].cast("double"))
    return seq.select("symbol", F.col("dt").cast("string").alias("dt"), F.col("i").cast("long").alias("i"), F.size("seq").cast("long").alias("n"), (F.round(total, 2) + 0.0).alias("total"), (F.round(F.col("seq")[0][0].cast("double"), 2) + 0.0).alias("oldest"))


@add("forward_returns", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, {', '.join(f'round(CASE WHEN count(LogRet) OVER w{h} = {h} THEN sum(LogRet) OVER w{h} END, 4) + 0e0 AS r{h}' for h in (1, 5, 20))} FROM ({_RET}) WINDOW {', '.join(f'w{h} AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)' for h in (1, 5, 20))}")
def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _returns(spark, sf_dir)
    return _tidy(rows.select("symbol", "dt", *[splits.forward_return("LogRet", h).alias(f"r{h}") for h in (1, 5, 20)]))


@add("direction_labels", f"""{BARS}, a AS (SELECT *, lag(Close) OVER (PARTITION BY symbol ORDER BY dt) AS p FROM ({_RET})), t AS (SELECT *, greatest(High - Low, abs(High - p), abs(Low - p)) AS tr FROM a),
    m AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM t WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
    b AS (SELECT *, LogRet / greatest(first_value(atr IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / (Close + 1e-9), 1e-6) AS u FROM m)
    SELECT symbol, CAST(dt AS VARCHAR) AS dt, CASE WHEN u > 25e-2 THEN 1e0 WHEN u < -25e-2 THEN 0e0 ELSE 5e-1 END AS direction, round(99e-2 * CASE WHEN u > 25e-2 THEN 1e0 WHEN u < -25e-2 THEN 0e0 ELSE 5e-1 END + 5e-3, 4) AS smooth FROM b""")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.with_direction(_returns(spark, sf_dir), "LogRet")
    return _tidy(rows.select("symbol", "dt", "direction", splits.smooth(F.col("direction")).alias("smooth")))


for _kind, _cut in (("pretrain", "n - greatest(20, least(60, n // 5))"), ("finetune", "CAST(floor(0.8 * n) AS BIGINT)")):

    @add(f"embargo_{_kind}", f"{BARS}, a AS (SELECT symbol, dt, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), c AS (SELECT *, {_cut} AS cut FROM a) SELECT symbol, part, count(*) AS n, CAST(min(dt) AS VARCHAR) AS first, CAST(max(dt) AS VARCHAR) AS last FROM (SELECT *, CASE WHEN i < cut - 20 THEN 'train' WHEN i >= cut + 20 THEN 'val' END AS part FROM c) GROUP BY symbol, part")
    def _embargo(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return splits.holdout(_daily(spark, sf_dir), kind).groupBy("symbol", "part").agg(F.count("*").alias("n"), F.min("dt").cast("string").alias("first"), F.max("dt").cast("string").alias("last"))


@add("walk_forward_splits", f"""{BARS}, d AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM bars)), s AS (SELECT unnest(range(0, CAST(floor(((SELECT count(*) FROM d) - 1048) / 126.0) AS BIGINT) + 1)) AS k)
    SELECT CAST(k AS INTEGER) AS split_id, {', '.join(f'CAST((SELECT dt FROM d WHERE i = k * 126 + {o}) AS VARCHAR) AS {n}' for n, o in (('train_start', 0), ('train_end', 755), ('test_start', 796), ('test_end', 1047)))}, 20 AS purge_days, 20 AS embargo_days, 756 AS train_days, 252 AS test_days FROM s""")
def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(splits.walk_forward(_daily(spark, sf_dir).select("dt")))


#: Rows with the next bar's return as y, known on that bar's day; days are numbered, splits are those of the calendar.
_WALK = f"""t AS (SELECT symbol, dt, LogRet AS x, lead(LogRet) OVER (PARTITION BY symbol ORDER BY dt) AS y, lead(dt) OVER (PARTITION BY symbol ORDER BY dt) AS known FROM ({_RET})),
    d AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i FROM (SELECT DISTINCT dt FROM bars)), s AS (SELECT unnest(range(0, CAST(floor(((SELECT count(*) FROM d) - 1048) / 126.0) AS BIGINT) + 1)) AS k),
    r AS (SELECT t.symbol, x, y, d.i, e.i AS j FROM t JOIN d USING (dt) JOIN d e ON e.dt = t.known WHERE x IS NOT NULL AND y IS NOT NULL),
    g AS (SELECT symbol, k, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r JOIN s ON i >= k * 126 AND i < k * 126 + 756 AND j < k * 126 + 796 GROUP BY symbol, k),
    m AS (SELECT symbol, k, n, ((sxx + 1) * sy - sx * sxy) / ((n + 1) * (sxx + 1) - sx * sx) AS a, ((n + 1) * sxy - sx * sy) / ((n + 1) * (sxx + 1) - sx * sx) AS b FROM g),
    p AS (SELECT r.symbol, k, y, a + b * x AS z FROM r JOIN m ON m.symbol = r.symbol AND i >= k * 126 + 796 AND i < k * 126 + 1048)"""


def _walk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).withColumns({"y": F.lead("LogRet").over(splits.series()), "known": F.lead("dt").over(splits.series())})


@add("walk_forward_fits", f"""{BARS}, {_WALK} SELECT m.symbol, m.k AS split_id, m.n AS train_rows, count(z) AS test_rows, round(any_value(a), 4) + 0e0 AS intercept, round(any_value(b), 4) + 0e0 AS slope, round(sqrt(avg((y - z) * (y - z))), 4) + 0e0 AS rmse,
    round(1 - sum((y - z) * (y - z)) / (CASE WHEN count(y) > 1 THEN var_pop(y) * count(y) END), 4) + 0e0 AS r2, round(avg(z) - avg(y), 4) + 0e0 AS bias FROM m LEFT JOIN p ON p.symbol = m.symbol AND p.k = m.k GROUP BY m.symbol, m.k, m.n""")
def _walk_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = walkforward.fit(_walk_rows(spark, sf_dir), ["LogRet"], "y", "known")
    return _tidy(made.select("symbol", "split_id", "train_rows", "test_rows", F.col("coefficients")[0].alias("intercept"), F.col("coefficients")[1].alias("slope"), "rmse", "r2", "bias"))


@add("walk_forward_scores", f"""{BARS}, {_WALK} SELECT symbol, k AS split_id, count(*) AS n, round(avg(abs(y - z)), 4) + 0e0 AS mae, round(median(abs(y - z)), 4) + 0e0 AS median_miss, round(avg(CASE WHEN (y > 0) = (z > 0) THEN 1e0 ELSE 0e0 END), 4) + 0e0 AS hit_rate FROM p GROUP BY symbol, k""")
def _walk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _walk_rows(spark, sf_dir)
    days = walkforward.calendar(rows)
    single = walkforward.predictions(rows, walkforward.fit(rows, ["LogRet"], "y", "known", days=days), ["LogRet"], "y", "known", days=days)
    miss, hit = F.abs(F.col("actual") - F.col("predicted")), ((F.col("actual") > 0) == (F.col("predicted") > 0)).cast("double")
    return _tidy(single.groupBy("symbol", "split_id").agg(F.count("*").alias("n"), F.avg(miss).alias("mae"), F.median(miss).alias("median_miss"), F.avg(hit).alias("hit_rate")))


@add("scaled_columns", f"""{BARS}, a AS (SELECT symbol, dt, Close, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), t AS (SELECT *, i < CAST(floor(0.8 * n) AS BIGINT) - 20 AS tr FROM a)
    SELECT symbol, CAST(dt AS VARCHAR) AS dt, round((Close - min(Close) FILTER (tr) OVER w) / (max(Close) FILTER (tr) OVER w - min(Close) FILTER (tr) OVER w), 4) + 0e0 AS minmax, round((Close - avg(Close) FILTER (tr) OVER w) / stddev_pop(Close) FILTER (tr) OVER w, 4) + 0e0 AS standard FROM t WINDOW w AS (PARTITION BY symbol)""")
def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.holdout(_daily(spark, sf_dir), "finetune")
    both = splits.scale(splits.scale(rows, ["Close"], "minmax").withColumnRenamed("Close_scaled", "minmax"), ["Close"], "standard").withColumnRenamed("Close_scaled", "standard")
    return _tidy(both.select("symbol", "dt", "minmax", "standard"))


add("last_rows", f"{BARS} SELECT symbol, count(*) AS n, CAST(min(dt) AS VARCHAR) AS first FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS b, count(*) OVER (PARTITION BY symbol) AS c FROM bars) WHERE c >= 150 AND b <= 200 GROUP BY symbol")(
    lambda s, d: splits.last_rows(_daily(s, d)).groupBy("symbol").agg(F.count("*").alias("n"), F.min("dt").cast("string").alias("first"))
)
add("tabular_dataset", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(LogRet, 4) + 0e0 AS LogRet, round(y, 4) + 0e0 AS y FROM (SELECT *, lead(LogRet) OVER (PARTITION BY symbol ORDER BY dt) AS y FROM ({_RET})) WHERE LogRet IS NOT NULL AND y IS NOT NULL")(
    lambda s, d: _tidy(splits.tabular(_returns(s, d), ["LogRet"]))
)


_SCANS_SQL = f"""{BARS}, r AS (SELECT symbol, dt, Close, CASE WHEN Close > Open THEN Volume WHEN Close < Open THEN -Volume ELSE 0e0 END AS signed, row_number() OVER w AS i, max(CASE WHEN Close > Open THEN 0 ELSE 1 END * row_number) OVER w AS ended
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS row_number FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
    e AS (SELECT a.symbol, a.i, sum(CASE WHEN b.i = 1 THEN 1e0 ELSE 2e0 / 13e0 END * power(11e0 / 13e0, a.i - b.i) * b.Close) AS mean FROM r a JOIN r b ON a.symbol = b.symbol AND b.i <= a.i AND b.i > a.i - 300 GROUP BY a.symbol, a.i)
    SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(sum(signed) OVER (PARTITION BY symbol ORDER BY dt), 4) + 0e0 AS volume_flow, i - ended AS rising, round(mean, 2) + 0e0 AS mean12 FROM r JOIN e USING (symbol, i)"""


def _scans() -> scans.Scans:
    gain = F.col("Close") - F.col("Open")
    return scans.Scans({"volume_flow": F.signum(gain) * F.col("Volume")}, {"rising": gain > 0}, {"mean12": (F.col("Close"), 12.0)})


def _tidy_scans(made: DataFrame) -> DataFrame:
    return made.select("symbol", F.col("dt").cast("string").alias("dt"), rounded("volume_flow"), "rising", (F.round("mean12", 2) + 0.0).alias("mean12"))


@add("long_series_scans", _SCANS_SQL)
def _long_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 1,000 rows, so that the supplied series are cut too."""
    return _tidy_scans(scans.scan(_daily(spark, sf_dir), _scans(), 1_000))


@add("streamed_scans", _SCANS_SQL)
def _streamed_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that gets the bars in three parts and is begun anew from its checkpoint for each."""
    bars, path = scratch.written(_daily(spark, sf_dir), "bars"), scratch_path(spark, "streamed")
    for part in ("dt < '1996-07-01'", "dt >= '1996-07-01' AND dt < '1997-07-01'", "dt >= '1997-07-01'"):
        bars.filter(part).write.mode("append").parquet(f"{path}/in")
        stream = running.running(spark.readStream.schema(bars.schema).parquet(f"{path}/in"), _scans())
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return _tidy_scans(spark.read.parquet(f"{path}/out").filter(~F.col("late")))


# -- signals -------------------------------------------------------------------------------------------------------------------

#: Predictions made from customers: one symbol each, class by balance.
_PRED = f"SELECT 'S' || CAST(c_custkey AS VARCHAR) AS symbol, {mapping.level_of_sql('abs(c_acctbal) / 1e4')} AS volatility_class, round(c_acctbal / 1e5, 4) AS predicted_return FROM customer"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns are rounded by way of the product, as DuckDB does: 845 / 1e5 times 1e4 lies just below 84.5, but F.round to four places goes by the digits 0.00845, and up. Ranks depend on it."""
    rows = fx.table(spark, sf_dir, "customer")
    return rows.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("symbol"), mapping.level_of(F.abs("c_acctbal") / 1e4).alias("volatility_class"), (F.round(F.col("c_acctbal") / 1e5 * 1e4) / 1e4).alias("predicted_return"))


@add("ranked_reports", f"""WITH p AS ({_PRED}) SELECT symbol, volatility_class, round(predicted_return, 4) + 0e0 AS predicted_return, CAST(rank AS INTEGER) AS rank, report FROM (
    SELECT *, row_number() OVER (PARTITION BY volatility_class ORDER BY predicted_return DESC, symbol) AS rank, 'top' AS report FROM p UNION ALL
    SELECT *, row_number() OVER (PARTITION BY volatility_class ORDER BY predicted_return, symbol DESC) AS rank, 'bottom' AS report FROM p UNION ALL
    SELECT *, row_number() OVER (ORDER BY predicted_return DESC, symbol) AS rank, 'overall' AS report FROM p) WHERE report = 'overall' OR rank <= 20""")
def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(signals.ranked(_predictions(spark, sf_dir)))


@add("verdicts", """WITH m AS (SELECT event_type AS symbol, avg(value / 500) AS d, avg(abs(value / 500 - 5e-1)) AS i, avg(CASE WHEN event_type < 'm' THEN value / 100 ELSE -value / 300 END) AS c FROM events GROUP BY event_type)
    SELECT symbol, CASE WHEN d > 65e-2 AND c > 1 THEN 'BULLISH' WHEN d < 35e-2 AND c < -1 THEN 'BEARISH' WHEN d > 55e-2 AND c > 3e-1 THEN 'BULLISH' WHEN d < 45e-2 AND c < -3e-1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS verdict,
    round(CASE WHEN (d > 65e-2 AND c > 1) OR (d < 35e-2 AND c < -1) THEN least(95e0, 60 + i * 30) WHEN (d > 55e-2 AND c > 3e-1) OR (d < 45e-2 AND c < -3e-1) THEN least(75e0, 50 + i * 20) ELSE 40 + 20 * least(1e0, i) END, 4) + 0e0 AS confidence,
    CASE WHEN d > 65e-2 AND c > 1 THEN 'Strong upward momentum with high conviction' WHEN d < 35e-2 AND c < -1 THEN 'Strong downward pressure with high conviction' WHEN d > 55e-2 AND c > 3e-1 THEN 'Moderate upward trend with positive signals' WHEN d < 45e-2 AND c < -3e-1 THEN 'Moderate downward trend with negative signals' ELSE 'Mixed signals with no clear directional bias' END AS reason FROM m""")
def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), (F.col("value") / 500).alias("dir_prob"), (F.col("value") / 500 - 0.5).alias("intensity"), F.when(F.col("event_type") < "m", F.col("value") / 100).otherwise(-F.col("value") / 300).alias("change"))
    return _tidy(signals.verdict(rows).select("symbol", "verdict", "confidence", "reason"))


@add("ensemble_signals", """WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS symbol, c_acctbal / 1e6 AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal / 2e6 - 1e-3 END AS b, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 3e6 + 1e-3 END AS c, (c_custkey % 101) / 1e2 AS p, (c_custkey % 7) / 7e0 AS i FROM customer),
    f AS (SELECT *, (a * 6e-1 + coalesce(b * 25e-2, 0) + coalesce(c * 15e-2, 0)) / (6e-1 + CASE WHEN b IS NULL THEN 0 ELSE 25e-2 END + CASE WHEN c IS NULL THEN 0 ELSE 15e-2 END) AS r FROM x),
    g AS (SELECT *, list_filter([CASE WHEN p > 48e-2 AND p < 52e-2 THEN 'DL dir prob near 0.5' END, CASE WHEN abs(r) < 3e-3 THEN 'Ensemble expected move too small' END, CASE WHEN (b IS NOT NULL AND sign(b) <> sign(a)) OR (c IS NOT NULL AND sign(c) <> sign(a)) THEN 'Model disagreement (DL vs trees)' END], lambda z: z IS NOT NULL) AS why FROM f)
    SELECT symbol, CASE WHEN len(why) > 0 THEN 'NO_TRADE' WHEN r > 0 THEN 'LONG' ELSE 'SHORT' END AS action, round(100 * exp(r), 4) + 0e0 AS target_price, round(r * 100, 4) + 0e0 AS expected_ret_pct, round(CASE WHEN len(why) > 0 THEN greatest(0e0, 1 - 25e-2 * len(why)) ELSE least(1e0, 6e-1 + i * 3e-1) END, 4) + 0e0 AS confidence, array_to_string(why, '; ') AS no_trade_reasons FROM g""")
def _ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    rows = fx.table(spark, sf_dir, "customer").select(
        k.cast("string").alias("symbol"), (v / 1e6).alias("dl_ret"), F.when(k % 3 != 0, v / 2e6 - 1e-3).alias("lgbm_ret"), F.when(k % 4 != 0, v / 3e6 + 1e-3).alias("xgb_ret"), (k % 101 / 1e2).alias("dir_prob"), (k % 7 / 7.0).alias("intensity"), F.lit(100.0).alias("last_close"),
    )
    return _tidy(signals.ensemble(rows))


@add("forecasts", f"""{BARS}, l AS (SELECT symbol, max(dt) AS dt, max_by(Close, dt) AS c, avg(LogRet) AS r FROM ({_RET}) GROUP BY symbol)
    SELECT symbol, CAST(dt + CASE isodow(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS VARCHAR) AS prediction_date, round(c * exp(least(greatest(coalesce(r, 0), -2e-1), 2e-1)), 4) + 0e0 AS predicted_price, round(exp(least(greatest(coalesce(r, 0), -2e-1), 2e-1)) - 1, 4) + 0e0 AS predicted_return FROM l""")
def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _returns(spark, sf_dir).groupBy("symbol").agg(F.max("dt").alias("dt"), F.max_by("Close", "dt").alias("last_close"), F.avg("LogRet").alias("predicted_log_return"))
    return _tidy(signals.forecast(last).select("symbol", "prediction_date", "predicted_price", "predicted_return"))


@add("holdout_metrics", f"""{BARS}, h AS (SELECT symbol, lag(Close) OVER w AS base, Close AS act, lag(LogRet) OVER w / 2 AS pred, LogRet AS y, CASE WHEN lag(LogRet) OVER w > 0 THEN 4e-1 ELSE 6e-1 END AS p FROM ({_RET}) WINDOW w AS (PARTITION BY symbol ORDER BY dt)), k AS (SELECT *, act - base * exp(pred) AS m FROM h WHERE pred IS NOT NULL),
    d AS (SELECT *, CASE WHEN y > 15e-4 THEN 1 WHEN y < -15e-4 THEN 0 END AS want, CASE WHEN p > 55e-2 THEN 1 WHEN p < 45e-2 THEN 0 END AS said FROM k)
    SELECT symbol, round(avg(abs(m)), 4) + 0e0 AS mae, round(sqrt(avg(m * m)), 4) + 0e0 AS rmse, round(1 - sum(m * m) / (var_pop(act) * count(act)), 4) + 0e0 AS r2, round(coalesce(avg(CASE WHEN want = said THEN 1e0 WHEN want <> said THEN 0e0 END) * 100, 0), 4) + 0e0 AS dir_hit_rate FROM d GROUP BY symbol""")
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("LogRet").over(splits.series())
    rows = _returns(spark, sf_dir).select("symbol", F.lag("Close").over(splits.series()).alias("base_close"), F.col("Close").alias("actual_close"), (before / 2).alias("predicted_log_return"), F.col("LogRet").alias("actual_log_return"), F.when(before > 0, 0.4).otherwise(0.6).alias("dir_prob"))
    return _tidy(signals.holdout_metrics(rows.filter("predicted_log_return IS NOT NULL")))


@add("symbol_scores", f"""{BARS}, x AS (SELECT symbol, dt, Close / lag(Close, 126) OVER w - 1 AS g, (Close - avg(Close) OVER f) / (stddev_samp(Close) OVER f + 1e-9) AS a, row_number() OVER w AS n, Close / lag(Close) OVER w - 1 AS r, Market / lag(Market) OVER w - 1 AS m FROM ({INDEXED}) WINDOW w AS (PARTITION BY symbol ORDER BY dt), f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT symbol, round(max_by(g, dt), 4) + 0e0 AS momentum, round(max_by(a, dt), 4) + 0e0 AS reversion, round(covar_samp(r, m) / (var_pop(CASE WHEN r IS NOT NULL THEN m END) + 1e-12), 4) + 0e0 AS beta FROM x GROUP BY symbol""")
def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(signals.scores(_indexed(spark, sf_dir)))


# -- backtest ------------------------------------------------------------------------------------------------------------------

_ABOVE = f"SELECT symbol, dt, Close, LogRet AS r, CASE WHEN count(Close) OVER f = 20 THEN Close > avg(Close) OVER f ELSE false END AS above FROM ({_RET}) WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
CURVE = f"""{BARS}, ab AS ({_ABOVE}), hd AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY symbol ORDER BY dt), false) AS held FROM ab),
    day AS (SELECT dt, 2e-2 * avg(CASE WHEN held THEN coalesce(r, 0e0) ELSE 0e0 END) AS log_ret, avg(CASE WHEN held THEN 1e0 ELSE 0e0 END) AS exposure, sum(CASE WHEN held THEN 1 ELSE 0 END) AS positions, avg(r) AS market FROM hd GROUP BY dt),
    cv AS (SELECT *, 1e6 * exp(sum(log_ret) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS equity, exp(log_ret) - 1 AS ret, avg(market) OVER (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS drift, coalesce(stddev_samp(market) OVER (ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0e0) AS noise FROM day),
    curve AS (SELECT *, CASE WHEN drift > 2e-3 THEN 'BULL' WHEN drift < -2e-3 THEN 'BEAR' ELSE 'NEUTRAL' END AS trend, CASE WHEN noise > 5e-1 THEN 'HIGH_VOL' WHEN noise < 3e-1 THEN 'LOW_VOL' ELSE 'MID_VOL' END AS vol FROM cv)"""
TRADES = f"""{CURVE}, rn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - sum(CASE WHEN held THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS g FROM hd),
    tr AS (SELECT symbol, min(dt) AS entry_date, max(dt) AS exit_date, min_by(Close, dt) AS entry_value, max_by(Close, dt) AS exit_value FROM rn WHERE held GROUP BY symbol, g),
    trades AS (SELECT *, 1e-3 * (entry_value + exit_value) AS total_cost, exit_value - entry_value - 1e-3 * (entry_value + exit_value) AS net_pnl, date_diff('day', entry_date, exit_date) AS holding_days FROM tr)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.trend_following(_daily(spark, sf_dir))[0]


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.trend_following(_daily(spark, sf_dir))[1]


@add("portfolio_metrics", f"""{CURVE}, dd AS (SELECT *, equity / max(equity) OVER (ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM curve), o AS (SELECT min(dt) AS a, max(dt) AS b, min_by(equity, dt) AS x, max_by(equity, dt) AS y, avg(ret) AS m, stddev_samp(ret) AS s, sqrt(avg(power(least(ret, 0), 2))) AS down, min(dd) AS mdd, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS w, avg(exposure) AS e, avg(positions) AS p FROM dd)
    SELECT CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date, round(ln(y / x), 4) + 0e0 AS log_growth, round(m * sqrt(252e0) / s, 4) + 0e0 AS Sharpe, round(m * sqrt(252e0) / down, 4) + 0e0 AS Sortino, round(mdd, 4) + 0e0 AS MaxDD, round(w, 4) + 0e0 AS Daily_Win_Rate, round(s * sqrt(252e0), 4) + 0e0 AS Ann_Vol, round(e, 4) + 0e0 AS avg_exposure, round(p, 4) + 0e0 AS avg_positions,
    round(ln(power(y / x, 36525e-2 / greatest(date_diff('day', a, b), 1))), 4) + 0e0 AS log_CAGR, round(ln(abs((power(y / x, 36525e-2 / date_diff('day', a, b)) - 1) / mdd)), 4) + 0e0 AS log_Calmar FROM o""")
def _portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = backtest.metrics(_curve(spark, sf_dir)).withColumns({"log_growth": F.ln(F.col("end_value") / F.col("start_value")), "log_CAGR": F.log1p("CAGR"), "log_Calmar": F.ln(F.abs("Calmar"))})
    return _tidy(m.select("start_date", "end_date", "log_growth", "Sharpe", "Sortino", "MaxDD", "Daily_Win_Rate", "Ann_Vol", "avg_exposure", "avg_positions", "log_CAGR", "log_Calmar"))


@add("regime_performance", f"""{CURVE} SELECT CASE WHEN vol IS NULL THEN 'trend' WHEN trend IS NULL THEN 'vol' ELSE 'trend_vol' END AS regime_type, concat_ws('_', trend, vol) AS regime, count(*) AS observations, round(avg(ret), 4) + 0e0 AS mean_daily_ret, round(avg(ret) * sqrt(252e0) / nullif(stddev_samp(ret), 0), 4) + 0e0 AS sharpe, round(avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END), 4) + 0e0 AS hit_rate, round(avg(exposure), 4) + 0e0 AS avg_exposure FROM curve GROUP BY GROUPING SETS ((trend), (vol), (trend, vol))""")
def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(backtest.by_regime(_curve(spark, sf_dir)))


@add("yearly_performance", f"{CURVE} SELECT CAST(year(dt) AS INTEGER) AS year, round(max_by(equity, dt) / min_by(equity, dt) - 1, 4) + 0e0 AS year_return FROM curve GROUP BY year(dt)")
def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(backtest.by_year(_curve(spark, sf_dir)).select("year", "year_return"))


@add("trade_metrics", f"{TRADES} SELECT count(*) AS total_trades, count(DISTINCT symbol) AS unique_traded_stocks, round(avg(CASE WHEN net_pnl > 0 THEN 1e0 ELSE 0e0 END), 4) + 0e0 AS trade_hit_rate, round(sum(greatest(net_pnl, 0)) / abs(sum(least(net_pnl, 0))), 4) + 0e0 AS profit_factor, round(avg(net_pnl / entry_value), 4) + 0e0 AS avg_trade_return, round(avg(holding_days), 4) + 0e0 AS avg_holding_days, round(sum(total_cost), 2) + 0e0 AS total_cost_drag, round(sum(entry_value + exit_value) / 1e6, 4) + 0e0 AS turnover_multiple FROM trades")
def _trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _tidy(backtest.trade_metrics(_trades(spark, sf_dir), 1e6).withColumn("total_cost_drag", F.round("total_cost_drag", 2)))
    return m


@add("extreme_trades", f"{TRADES} SELECT symbol, CAST(entry_date AS VARCHAR) AS entry_date, round(net_pnl, 2) + 0e0 AS net_pnl, kind FROM ((SELECT *, 'top' AS kind FROM trades ORDER BY net_pnl DESC, symbol, entry_date LIMIT 5) UNION ALL (SELECT *, 'worst' AS kind FROM trades ORDER BY net_pnl, symbol, entry_date LIMIT 5))")
def _extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(backtest.extreme_trades(_trades(spark, sf_dir)).select("symbol", "entry_date", F.round("net_pnl", 2).alias("net_pnl"), "kind"))


@add("capacity", f"{BARS}, v AS (SELECT symbol, avg(Close * Volume) AS adv FROM bars GROUP BY symbol HAVING avg(Close * Volume) >= 1e4) SELECT 10 AS top_k, round(quantile_cont(adv, 0.5), 2) + 0e0 AS median_adv_selected, round(quantile_cont(adv, 0.25), 2) + 0e0 AS p25_adv_selected FROM v")
def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = backtest.capacity(_daily(spark, sf_dir).select("symbol", (F.col("Close") * F.col("Volume")).alias("value")), 10, 1e4)
    return c.select("top_k", *[(F.round(n, 2) + 0.0).alias(n) for n in ("median_adv_selected", "p25_adv_selected")])


# -- models (rows only) --------------------------------------------------------------------------------------------------------


@add("model_baseline")
def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["RSI14", "MomentumZ", "VolZ", "Range", "CandlePos"]
    rows = splits.holdout(splits.tabular(feat.features(_indexed(spark, sf_dir), [*names, "LogRet"]), names), "finetune")
    model = models.fit_baseline(rows.filter("part = 'train'"), names)
    scored = models.score(model, rows.filter("part = 'val'"))
    return scored.select("symbol", F.col("dt").cast("string").alias("dt"), "predicted_log_return", "dir_prob", signals.direction_of(F.col("dir_prob")).alias("predicted_direction"))


_FINISHED = ["Close", "RSI14", "EMA20", "ATR", "Vol20", "KAMA20", "Bullish_Evidence_Total"]
_FILLED = ", ".join(f"coalesce(last_value({n} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING), first_value({n} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {n}" for n in _FINISHED)


@add("feature_table_finished", f"{BARS}, f AS (SELECT symbol, dt, {_FILLED} FROM ({feat.features_sql(INDEXED, _FINISHED)})) SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_short_sql(_FINISHED)} FROM f WHERE Close IS NOT NULL")
def _finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = feat.finish(feat.features(_indexed(spark, sf_dir), _FINISHED), _FINISHED)
    return done.select("symbol", F.col("dt").cast("string").alias("dt"), *_short(done, _FINISHED))


# -- small operators -----------------------------------------------------------------------------------------------------------

add("standardise_columns", "SELECT o_orderkey AS Volume, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS Date FROM orders")(
    lambda s, d: clean.standardise_columns(fx.table(s, d, "orders").select(F.col("o_orderkey").alias(" VOLUME"), F.to_date("o_orderdate").cast("string").alias("date")))
)
add("parse_dates", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS dt FROM events")(
    lambda s, d: _tidy(clean.parse_dates(fx.table(s, d, "events").select("event_id", F.lit("no date").alias("date"), F.col("ts").cast("string").alias("timestamp"))).select("event_id", "dt"))
)
add("cutoff_filter", f"{BARS} SELECT symbol, count(*) AS n, CAST(max(dt) AS VARCHAR) AS last FROM bars WHERE dt <= DATE '1998-03-31' GROUP BY symbol")(
    lambda s, d: clean.until(_daily(s, d), "1998-03-31").groupBy("symbol").agg(F.count("*").alias("n"), F.max("dt").cast("string").alias("last"))
)
add("log_and_bounds", "SELECT c_custkey, round(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 4) + 0e0 AS log, round(least(greatest(c_acctbal * 1e3, -1e6), 1e6), 4) + 0e0 AS bounded, round(c_acctbal / (c_nationkey + 1e-9) * CASE WHEN c_nationkey = 0 THEN 1e-9 ELSE 1e0 END, 2) + 0e0 AS safe FROM customer")(
    lambda s, d: fx.table(s, d, "customer").select("c_custkey", (F.round(clean.safe_log(F.col("c_acctbal")), 4) + 0.0).alias("log"), (F.round(clean.bounded(F.col("c_acctbal") * 1e3), 4) + 0.0).alias("bounded"), (F.round(F.try_divide("c_acctbal", F.col("c_nationkey") + 1e-9) * F.when(F.col("c_nationkey") == 0, 1e-9).otherwise(1.0), 2) + 0.0).alias("safe"))
)
add("intensity_labels", f"{BARS}, r AS (SELECT symbol, dt, LogRet, avg(LogRet) OVER (PARTITION BY symbol) AS m, stddev_pop(LogRet) OVER (PARTITION BY symbol) AS s FROM ({_RET})) SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(tanh((LogRet - m) / (8e-1 * s)), 4) + 0e0 AS intensity FROM r")(
    lambda s, d: _tidy(_returns(s, d).select("symbol", "dt", splits.intensity(F.col("LogRet"), F.avg("LogRet").over(Window.partitionBy("symbol")), F.stddev_pop("LogRet").over(Window.partitionBy("symbol"))).alias("intensity")))
)
add("evaluation_losses", """WITH x AS (SELECT c_acctbal / 1e5 AS y, c_acctbal / 2e5 AS p, [0.005, 0.5, 0.995, 0.3][CAST(c_custkey % 4 AS INTEGER) + 1] AS l, least(greatest((c_custkey % 101) / 1e2, 1e-7), 1 - 1e-7) AS q FROM customer),
    e AS (SELECT *, abs(y - p) AS a, l * q + (1 - l) * (1 - q) AS t FROM x)
    SELECT round(avg((1.5 + 3.5 * power(abs(y), 1.5)) * power(y - p, 2)), 6) AS weighted_mse, round(avg(CASE WHEN a < 5e-2 THEN 5e-1 * power(a, 2) / 5e-2 ELSE a - 25e-3 END), 6) AS huber, round(-avg(5e-1 * power(1 - t, 2) * ln(t)), 6) AS focal FROM e""")(
    lambda s, d: models.losses(fx.table(s, d, "customer").select((F.col("c_acctbal") / 1e5).alias("y"), (F.col("c_acctbal") / 2e5).alias("prediction"), F.element_at(F.array(*map(F.lit, (0.005, 0.5, 0.995, 0.3))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("label"), ((F.col("c_custkey") % 101) / 1e2).alias("prob"))).select(*[F.round(c, 6).alias(c) for c in ("weighted_mse", "huber", "focal")])
)
add("feature_union", "WITH m AS (SELECT c_nationkey AS bucket, c_name AS symbol, unnest([c_mktsegment, CAST(c_custkey % 3 AS VARCHAR)]) AS feature, unnest([0, 1]) AS place FROM customer), f AS (SELECT bucket, feature, min(struct_pack(symbol := symbol, place := place)) AS pos FROM m GROUP BY ALL) SELECT bucket, string_agg(feature, ',' ORDER BY pos, feature) AS features FROM f GROUP BY bucket")(
    lambda s, d: mapping.feature_union(fx.table(s, d, "customer").select(F.col("c_nationkey").alias("bucket"), F.col("c_name").alias("symbol"), F.array("c_mktsegment", (F.col("c_custkey") % 3).cast("string")).alias("features"))).select("bucket", F.array_join("features", ",").alias("features"))
)


@add("prediction_table", f"""{BARS}, l AS (SELECT symbol, max(dt) AS dt, max_by(Close, dt) AS c, avg(LogRet) AS r, CAST(min(dt) AS VARCHAR) AS a, CAST(max(dt) AS VARCHAR) AS b, count(*) AS n FROM ({_RET}) GROUP BY symbol), e AS (SELECT *, exp(least(greatest(r, -2e-1), 2e-1)) AS g FROM l)
    SELECT CAST(dt + CASE isodow(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS VARCHAR) AS prediction_date, CAST(dt AS VARCHAR) AS cutoff_date, symbol, round(c, 4) + 0e0 AS last_close, round(c * g, 4) + 0e0 AS predicted_price, round(g - 1, 4) + 0e0 AS predicted_return, CASE WHEN r > 0 THEN 'UP' ELSE 'DOWN' END AS predicted_direction, 'GENERIC' AS sector, 'HIGH' AS volatility_class, 'BUCKET_78' AS bucket_name, round(CASE WHEN r > 0 THEN 6e-1 ELSE 4e-1 END, 4) AS dir_prob, round(tanh(r), 4) + 0e0 AS intensity, 'yearly' AS model_stage_used, 'yearly/' || symbol AS parent_checkpoint_path, a AS data_window_start, b AS data_window_end, n AS rows_used FROM e""")
def _prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _returns(spark, sf_dir).groupBy("symbol").agg(F.max("dt").alias("dt"), F.max_by("Close", "dt").alias("last_close"), F.avg("LogRet").alias("predicted_log_return"), F.min("dt").cast("string").alias("window_start"), F.max("dt").cast("string").alias("window_end"), F.count("*").alias("rows_used"))
    scored = last.withColumns({"sector": F.lit("GENERIC"), "volatility_class": F.lit("HIGH"), "bucket_name": F.lit("BUCKET_78"), "dir_prob": F.when(F.col("predicted_log_return") > 0, 0.6).otherwise(0.4), "intensity": F.tanh("predicted_log_return"), "stage": F.lit("yearly"), "path": F.concat(F.lit("yearly/"), F.col("symbol"))})
    return _tidy(signals.prediction_table(scored))


# -- training and prediction -----------------------------------------------------------------------------------------------------

_CUTOFF, _PENALTY = "1998-06-30", 20.0
_MEMBERS = f"""members AS (SELECT symbol, annual_vol, {mapping.level_of_sql('annual_vol')} AS volatility_class, {mapping.sector_of_sql('symbol', "''")} AS sector,
    {mapping.bucket_number_sql(f"({mapping.level_of_sql('annual_vol')})", f"({mapping.sector_of_sql('symbol', chr(39) * 2)})")} AS bucket FROM {_VOL_SQL}),
    l0 AS (SELECT *, lag(Close) OVER w AS p, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({_RET}) WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
    l1 AS (SELECT *, greatest(High - Low, abs(High - p), abs(Low - p)) AS tr, i < n - greatest(20, least(60, n // 5)) - 20 AS train FROM l0),
    l2 AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr, avg(CASE WHEN train THEN LogRet END) OVER (PARTITION BY symbol) AS mu, stddev_pop(CASE WHEN train THEN LogRet END) OVER (PARTITION BY symbol) + 1e-9 AS sd FROM l1 WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
    l3 AS (SELECT *, LogRet / greatest(first_value(atr IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / (Close + 1e-9), 1e-6) AS u FROM l2),
    l4 AS (SELECT symbol, dt, LogRet, 99e-2 * CASE WHEN u > 25e-2 THEN 1e0 WHEN u < -25e-2 THEN 0e0 ELSE 5e-1 END + 5e-3 AS dir, tanh((LogRet - mu) / (8e-1 * sd)) AS int FROM l3),
    x AS (SELECT r.symbol, m.bucket, r.dt, r.LogRet AS x, lead(r.LogRet) OVER w AS ret, lead(r.dir) OVER w AS dir, lead(r.int) OVER w AS int FROM l4 r JOIN members m ON r.symbol = m.symbol WINDOW w AS (PARTITION BY r.symbol ORDER BY r.dt)),
    t AS (SELECT symbol, bucket, dt, x, ret, dir, int FROM x WHERE x IS NOT NULL AND ret IS NOT NULL AND int IS NOT NULL)"""


def _solved(target: str) -> tuple[str, str]:
    """The two coefficients of a fit with one feature, from its sums and its prior."""
    a, b = f"(s{target} + {_PENALTY} * p{target}0)", f"(sx{target} + {_PENALTY} * p{target}1)"
    det = f"((n + {_PENALTY}) * (sxx + {_PENALTY}) - sx * sx)"
    return f"((sxx + {_PENALTY}) * {a} - sx * {b}) / {det} AS {target}0", f"((n + {_PENALTY}) * {b} - sx * {a}) / {det} AS {target}1"


def _stage_fits() -> str:
    """CTEs of the four stages: y, m, w and d, and reg of all."""
    sums = "count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, " + ", ".join(f"sum({t}) AS s{t}, sum(x * {t}) AS sx{t}" for t in training.TARGETS)
    fits = ", ".join(x for t in training.TARGETS for x in _solved(t))
    zero = ", ".join(f"0e0 AS p{t}{k}" for t in training.TARGETS for k in (0, 1))
    out = [_MEMBERS, f"y AS (SELECT CAST(NULL AS VARCHAR) AS symbol, bucket, n, {fits} FROM (SELECT bucket, {sums}, {zero} FROM t WHERE dt <= DATE '{_CUTOFF}' GROUP BY bucket))"]
    parents, regs = ["y"], [("y", "yearly")]
    for name, stage in (("m", "monthly"), ("w", "weekly"), ("d", "daily")):
        prior = ", ".join(f"coalesce({', '.join(f'{p}.{t}{k}' for p in reversed(parents))}) AS p{t}{k}" for t in training.TARGETS for k in (0, 1))
        joined = " ".join(f"LEFT JOIN {p} ON {f'{p}.bucket = g.bucket' if p == 'y' else f'{p}.symbol = g.symbol'}" for p in parents)
        own = ", ".join(["g.symbol", "g.bucket", "g.n", "g.sx", "g.sxx", *[f"g.s{t}, g.sx{t}" for t in training.TARGETS]])
        out.append(f"{name} AS (SELECT symbol, bucket, n, {fits} FROM (SELECT {own}, {prior} FROM (SELECT symbol, bucket, {sums} FROM t WHERE dt <= DATE '{_CUTOFF}' AND dt >= DATE '{_CUTOFF}' - {clean.STAGE_DAYS[stage]} GROUP BY symbol, bucket) g {joined}))")
        parents.append(name)
        regs.append((name, stage))
    out.append("reg AS (" + " UNION ALL ".join(f"SELECT symbol, bucket, '{stage}' AS stage, n, {', '.join(f'{t}{k}' for t in training.TARGETS for k in (0, 1))} FROM {name}" for name, stage in regs) + ")")
    return ", ".join(out)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.annual_volatility(_daily(spark, sf_dir)).withColumn("volatility_class", mapping.level_of(F.col("annual_vol"))).withColumn("sector", mapping.sector_of(F.col("symbol"), F.lit("")))
    return rows.withColumn("bucket", mapping.bucket_number(F.col("volatility_class"), F.col("sector")))


@add("stage_fits", f"{BARS}, {_stage_fits()} SELECT symbol, bucket, stage, n AS rows_used, {', '.join(f'round({t}{k}, 4) + 0e0 AS {t}{k}' for t in training.TARGETS for k in (0, 1))} FROM reg")
def _stage_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = training.train(training.with_targets(_returns(spark, sf_dir)), _members(spark, sf_dir), ["LogRet"], _CUTOFF, _PENALTY)
    return registry.select("symbol", "bucket", "stage", "rows_used", *[(F.round(F.col(t)[k], 4) + 0.0).alias(f"{t}{k}") for t in training.TARGETS for k in (0, 1)])


_BEST = ", ".join(f"coalesce({', '.join(f'{p}.{t}{k}' for p in 'dwmy')}) AS {t}{k}" for t in training.TARGETS for k in (0, 1))


@add("predict_only", f"""{BARS}, {_stage_fits()}, l AS (SELECT symbol, max(dt) AS dt, max_by(Close, dt) AS c, max_by(LogRet, dt) AS x, CAST(min(dt) AS VARCHAR) AS a, CAST(max(dt) AS VARCHAR) AS b, count(*) AS n FROM ({_RET}) WHERE LogRet IS NOT NULL AND dt <= DATE '{_CUTOFF}' GROUP BY symbol),
    k AS (SELECT l.*, v.sector, v.volatility_class, v.bucket, CASE WHEN d.symbol IS NOT NULL THEN 'daily' WHEN w.symbol IS NOT NULL THEN 'weekly' WHEN m.symbol IS NOT NULL THEN 'monthly' ELSE 'yearly' END AS stage, {_BEST}
        FROM l JOIN members v ON l.symbol = v.symbol LEFT JOIN d ON d.symbol = l.symbol LEFT JOIN w ON w.symbol = l.symbol LEFT JOIN m ON m.symbol = l.symbol LEFT JOIN y ON y.bucket = v.bucket),
    p AS (SELECT *, exp(least(greatest(ret0 + ret1 * x, -2e-1), 2e-1)) AS g, least(greatest(dir0 + dir1 * x, 0e0), 1e0) AS q, least(greatest(int0 + int1 * x, -1e0), 1e0) AS s FROM k)
    SELECT CAST(dt + CASE isodow(dt) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS VARCHAR) AS prediction_date, CAST(dt AS VARCHAR) AS cutoff_date, symbol, sector, volatility_class, bucket AS bucket_name, round(c, 4) + 0e0 AS last_close, round(c * g, 2) + 0e0 AS predicted_price, round(g - 1, 4) + 0e0 AS predicted_return,
    CASE WHEN q > 55e-2 THEN 'UP' WHEN q < 45e-2 THEN 'DOWN' ELSE 'NEUTRAL' END AS predicted_direction, round(q, 4) + 0e0 AS dir_prob, round(s, 4) + 0e0 AS intensity, stage AS model_stage_used, stage || '/' || CASE WHEN stage = 'yearly' THEN bucket ELSE symbol END || '/{_CUTOFF}' AS parent_checkpoint_path, a AS data_window_start, b AS data_window_end, n AS rows_used FROM p""")
def _predict_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, members = _returns(spark, sf_dir), _members(spark, sf_dir)
    registry = training.train(training.with_targets(rows), members, ["LogRet"], _CUTOFF, _PENALTY)
    table = training.predict_only(rows, members.drop("annual_vol"), registry, ["LogRet"], _CUTOFF)
    return _tidy(table.withColumn("predicted_price", F.round("predicted_price", 2)))


@add("model_trees")
def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for the return beside a logistic direction, over all held-out rows."""
    names = ["RSI14", "MomentumZ", "VolZ"]
    rows = splits.holdout(splits.tabular(feat.features(_indexed(spark, sf_dir), [*names, "LogRet"]), names), "finetune")
    scored = models.score(models.fit_baseline(rows.filter("part = 'train'"), names, trees=True), rows.filter("part = 'val'"))
    return scored.select("symbol", F.col("dt").cast("string").alias("dt"), "predicted_log_return", "dir_prob")


@add("loss_fits")
def _loss_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of all stages, fitted under the training losses with a stop on held-out rows."""
    return fits.train_under_losses(_returns(spark, sf_dir), _members(spark, sf_dir), ["LogRet"], _CUTOFF)


_BOOST = {"rounds": 3, "depth": 3, "rate": 0.3, "least": 5, "penalty": 1.0}
_BOOST_ON = ["RSI14", "MomentumZ", "VolZ", "Range", "CandlePos"]


@add("boosted_by_symbol", f"""{BARS}, f AS (SELECT symbol, dt, {', '.join(f'round({n}, 6) AS {n}' for n in _BOOST_ON)}, lead(LogRet) OVER (PARTITION BY symbol ORDER BY dt) AS y FROM ({feat.features_sql(INDEXED, [*_BOOST_ON, 'LogRet'])})),
    tab AS MATERIALIZED (SELECT symbol, CAST(dt - DATE '1970-01-01' AS BIGINT) AS day, [{', '.join(_BOOST_ON)}] AS v, CAST(round(round(y, 9) * 1e9) AS BIGINT) AS y FROM f WHERE y IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in _BOOST_ON)}),
    {boosting.boosted_sql('tab', len(_BOOST_ON), **_BOOST)} SELECT symbol, day, p FROM fitted{_BOOST['rounds']}""")
def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensembles of every symbol over all its rows, and what they predict for these."""
    made = feat.features(_indexed(spark, sf_dir), [*_BOOST_ON, "LogRet"])
    rows = splits.tabular(made.withColumns({n: F.round(n, 6) for n in _BOOST_ON}), _BOOST_ON).withColumn("y", F.round("y", 9))
    table = scratch.written(boosting.binned(rows, _BOOST_ON), "binned")
    return boosting.fit_boosted(table, **_BOOST)[1].select("symbol", "day", "p")


# -- sources and sinks: written to the shared folder and read back --------------------------------------------------------------------

_BARS_BACK = f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_doubles(_BAR)} FROM bars"


@add("csv_round_trip", _BARS_BACK)
def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of CSV files with a vendor's column names."""
    path = scratch_path(spark, "csv")
    bars = _daily(spark, sf_dir).select(F.col("symbol").alias("Symbol"), F.col("dt").alias("DATE"), *[F.col(c).alias(f" {c.upper()}") for c in _BAR])
    bars.write.option("header", True).csv(path)
    back = readers.read_bars_csv(spark, path, key="Symbol")
    return _tidy(back.select("symbol", "dt", *_BAR))


@add("csv_by_name", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, {_doubles(_BAR)}, CASE WHEN symbol < 'C' THEN round(Close - Open, 4) + 0e0 END AS move, CAST(3 AS BIGINT) AS left_out FROM bars")
def _csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two headers in one folder: columns in another order and one more in some, beside an empty file, one without rows and one that isn't text."""
    path, bars = scratch_path(spark, "headers"), _daily(spark, sf_dir)
    first = bars.filter("symbol < 'C'").select("Close", F.col("dt").alias("date"), "Volume", (F.col("Close") - F.col("Open")).alias("move"), "Open", "Low", "High", "symbol")
    first.write.option("header", True).csv(f"{path}/a")
    bars.filter("symbol >= 'C'").select(F.col("symbol").alias("Symbol"), F.col("dt").alias("DATE"), *[F.col(c).alias(c.lower()) for c in _BAR]).write.option("header", True).csv(f"{path}/b")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, data in (("empty", b""), ("bare", b"Date,Open,High\n"), ("broken", b"\xff\xfe\x00\x80,\x9f")):
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.csv"))
        out.write(bytearray(data))
        out.close()
    table, left = readers.scan_csv(spark, path)
    return _tidy(table.select("symbol", "dt", *_BAR, clean.number(F.col("move")).alias("move"), F.lit(left.count()).cast("long").alias("left_out")))


@add("csv_of_a_symbol", _BARS_BACK + " WHERE symbol = 'MACHINERY'")
def _symbol_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "symbols")
    _daily(spark, sf_dir).filter("symbol = 'MACHINERY'").select(F.col("dt").alias("Date"), *_BAR).write.option("header", True).csv(f"{path}/MACHINERY.NS.csv")
    return _tidy(readers.read_symbol_csv(spark, path, "MACHINERY").select("symbol", "dt", *_BAR))


@add("parquet_round_trip", _BARS_BACK + " WHERE symbol IN ('BUILDING', 'MACHINERY')")
def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By symbol; a second write replaces its own symbols only, and a read of two prunes the others."""
    path, bars = scratch_path(spark, "bars"), _daily(spark, sf_dir)
    sinks.write_bars(bars.withColumn("Close", F.when(F.col("symbol") == "BUILDING", 0.0).otherwise(F.col("Close"))), path)
    sinks.write_bars(bars.filter("symbol = 'BUILDING'"), path)
    return _tidy(readers.read_bars(spark, path, ["BUILDING", "MACHINERY"]).select("symbol", "dt", *_BAR))


@add("reports_round_trip", f"WITH p AS ({_PRED}), r AS (SELECT *, row_number() OVER (PARTITION BY volatility_class ORDER BY predicted_return DESC, symbol) AS rank FROM p) SELECT symbol, volatility_class, CAST(rank AS INTEGER) AS rank, 'top' AS report, '2000-01-31' AS cutoff FROM r WHERE rank <= 20")
def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    sinks.write_reports(signals.ranked(_predictions(spark, sf_dir)), path, "2000-01-31")
    back = spark.read.option("header", True).csv(path).filter("report = 'top'")
    return back.select("symbol", "volatility_class", F.col("rank").cast("int").alias("rank"), "report", F.col("cutoff").cast("string").alias("cutoff"))


@add("sequences_round_trip", f"{BARS} SELECT symbol, i, round(list_sum(s), 2) + 0e0 AS total FROM (SELECT symbol, row_number() OVER w - 1 AS i, list(Volume) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WHERE i >= 90")
def _sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sequences")
    sinks.write_sequences(splits.sequences(_daily(spark, sf_dir), ["Volume"], 90).select("symbol", "i", "seq"), path, "daily", "2000-01-31")
    back = readers.read_sequences(spark, path, "daily", "2000-01-31", seed=3)
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0].cast("double"))
    return back.select("symbol", F.col("i").cast("long").alias("i"), (F.round(total, 2) + 0.0).alias("total"))


@add("state_round_trip", "SELECT 'weekly' AS stage, count(*) AS symbols, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS cutoff FROM orders")
def _state_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "state")
    sinks.write_state(fx.table(spark, sf_dir, "orders").agg(F.lit("weekly").alias("stage"), F.count("*").alias("symbols"), F.max(F.to_date("o_orderdate")).cast("string").alias("cutoff")), path)
    return readers.read_state(spark, f"{path}/*.json", "stage string, symbols long, cutoff string")


@add("incremental_upsert", f"{BARS} SELECT symbol, CAST(dt AS VARCHAR) AS dt, round(CASE WHEN dt >= DATE '1998-01-01' THEN Close * 2 ELSE Close END, 4) + 0e0 AS Close FROM bars")
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of files through the stream; the second corrects a part of the first."""
    source, target, state = (scratch_path(spark, x) for x in ("arrivals", "target", "progress"))
    bars, schema = _daily(spark, sf_dir).select("symbol", "dt", "Close"), "symbol string, dt date, Close double"
    for part in (bars, bars.filter("dt >= '1998-01-01'").withColumn("Close", F.col("Close") * 2)):
        part.coalesce(1).write.mode("append").parquet(source)
        incremental.ingest(spark, source, schema, target, state).awaitTermination()
    return _tidy(incremental.current(spark, target, schema))


@add("fetched_bars", _BARS_BACK)
def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars fetched by a stream from an archive of files by symbol: two symbols up to the middle of 1995, then, from the checkpoint, all of them up to the last day."""
    archive, target, state = (scratch_path(spark, x) for x in ("archive", "fetched", "progress"))
    sinks.write_bars(_daily(spark, sf_dir), archive)
    spark.dataSource.register(fetching.Fetches)
    days = spark.read.parquet(archive).agg(F.min("dt"), F.max("dt")).first()
    symbols = sorted(r[0] for r in spark.read.parquet(archive).select("symbol").distinct().collect())
    for some, end in ((symbols[:2], "1995-06-30"), (symbols, str(days[1]))):
        stream = spark.readStream.format("fetches").options(symbols=",".join(some), start=str(days[0]), end=end, fetch="tidemark.sources.fetching:archive", at=archive).load()
        incremental.take_up(stream.filter("error IS NULL").drop("error"), target, state).awaitTermination()
    return _tidy(incremental.current(spark, target, fetching.Fetches({}).schema().removesuffix(", error string")))


@add("committed_indices", f"{BARS} SELECT CAST(dt AS VARCHAR) AS dt, upper(symbol) AS name, round(CASE WHEN symbol = 'BUILDING' THEN Close + 1 ELSE Close END, 4) + 0e0 AS close FROM bars")
def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every index's history in a table that is swapped at once: all of them, then one again with other values."""
    path, bars = scratch_path(spark, "indices"), _daily(spark, sf_dir)
    names = {r[0]: r[0].upper() for r in bars.select("symbol").distinct().collect()}
    first, again = readers.index_history(bars, names), readers.index_history(bars.filter("symbol = 'BUILDING'").withColumn("Close", F.col("Close") + 1), names)
    sinks.write_indices(first, path)
    sinks.write_indices(again, path)
    return _tidy(versions.read(spark, path, ", ".join(f"{n} {t}" for n, t in first.dtypes)))


add("index_history", f"{BARS} SELECT CAST(dt AS VARCHAR) AS dt, CASE symbol WHEN 'AUTOMOBILE' THEN 'NIFTY_AUTO' ELSE 'NIFTY50' END AS name, round(Close, 4) + 0e0 AS close FROM bars WHERE symbol IN ('AUTOMOBILE', 'BUILDING')")(
    lambda s, d: _tidy(readers.index_history(_daily(s, d), {"Automobile": "NIFTY_AUTO", "Building": "NIFTY50"}))
)
add("symbol_universe", "WITH e AS (SELECT 'S' || CAST(o_custkey % 50 AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' ELSE '.XX' END AS x FROM orders) SELECT DISTINCT split_part(x, '.', 1) AS SYMBOL, x AS SYMBOL_EXCHANGE, CASE WHEN x LIKE '%.NS' THEN 'NSE' ELSE 'BSE' END AS EXCHANGE FROM e WHERE x NOT LIKE '%.XX'")(
    lambda s, d: readers.universe(fx.table(s, d, "orders").select(F.col("o_orderkey").alias("i"), F.concat(F.lit(" s"), F.col("o_custkey") % 50, F.element_at(F.array(F.lit(".ns"), F.lit(".bo"), F.lit(".xx")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("entry"))).select("SYMBOL", "SYMBOL_EXCHANGE", "EXCHANGE")
)
