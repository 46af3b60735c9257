"""Readers of bar files, symbol masters and state, with declared schemas."""

from __future__ import annotations

import csv
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import BAR_NAMES, DATE_NAMES, clean_numbers, parse_dates, standardise_columns

PRICES = ["Open", "High", "Low", "Close", "Volume"]


def symbol_of_file(path):
    """A symbol from a file's name: the stem without index suffixes, exchange suffixes and signs, in upper case."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.csv(\.gz)?$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, r"(?i)_with_nifty.*$", ""), r"(?i)([._]NS|[._]?BSE|[._]BO)$", "")
    return F.upper(F.regexp_replace(bare, "[^A-Za-z0-9]", ""))


def csv_headers(spark: SparkSession, path: str, at_once: int = 32) -> dict[str, str | None]:
    """The first line of each CSV file (.csv, .csv.gz) in a folder and those below it, or of one file; None if it can't be read, empty if there is none. Only first lines are read, files in parallel."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = place.getFileSystem(conf)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    files, found = [], fs.listFiles(place, True)
    while found.hasNext():
        file = found.next().getPath()
        if file.getName().lower().endswith((".csv", ".csv.gz")) and not file.getName().startswith(("_", ".")):
            files.append(file)

    def first(file):
        try:
            stream = fs.open(file)
            try:
                codec = codecs.getCodec(file)
                strict = spark._jvm.java.nio.charset.StandardCharsets.UTF_8.newDecoder()  # reports what isn't UTF-8
                line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, strict)).readLine()
                return (line or "").removeprefix("\ufeff")
            finally:
                stream.close()
        except Exception:  # noqa: BLE001  whatever the file system or the codec raises
            return None

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip((f.toString() for f in files), pool.map(first, files), strict=True))


#: Names of which a header must have one, trimmed and in lower case.
KNOWN = {*BAR_NAMES, *(n.lower() for n in DATE_NAMES)}


def scan_csv(spark: SparkSession, path: str, key: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """A folder of CSV files, each with a header of its own, to one long table of bars, and the files that were left out (file, reason).

    Columns go by name: files of one header are one scan, and the scans are united by name, so that files may have columns in another order, fewer, or more. Of columns that have one name the first counts. Values are
    read as text and cleaned, so that one bad cell costs itself only. The symbol is the file's own column or its name. Left out are files without a line (``empty``), without a row (``no rows``), whose
    first line can't be read or decoded (``unreadable``), or names neither a date nor a price (``no known column``)."""
    groups, left = defaultdict(list), []
    for file, line in csv_headers(spark, path).items():
        names = [] if line is None else next(csv.reader([line]), [])
        reason = "unreadable" if line is None else "empty" if not line.strip() else None if any(n.strip().lower() in KNOWN for n in names) else "no known column"
        if reason:
            left.append((file, reason))
        else:
            groups[tuple(names)].append(file)
    table = None
    for names, files in groups.items():
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(", ".join(f"_{i} string" for i in range(len(names)))).csv(files)
        firsts = {n.strip().lower(): i for i, n in reversed(list(enumerate(names))) if n.strip()}
        one = raw.select(*[F.col(f"_{i}").alias(names[i].strip()) for i in sorted(firsts.values())], F.url_decode(F.regexp_replace("_metadata.file_name", "[+]", "%2B")).alias("_file"))
        table = standardise_columns(one) if table is None else table.unionByName(standardise_columns(one), allowMissingColumns=True)
    if table is None:
        table = spark.createDataFrame([], "Date string, _file string")
    seen = table.select(F.col("_file").alias("name")).distinct()
    every = spark.createDataFrame([(f, f.rsplit("/", 1)[-1]) for fs in groups.values() for f in fs], "file string, name string")
    bare = every.join(seen, "name", "left_anti").select("file", F.lit("no rows").alias("reason"))
    return _bars_of(table, key), spark.createDataFrame(left, "file string, reason string").unionByName(bare)


def read_bars_csv(spark: SparkSession, path: str, key: str = "symbol") -> DataFrame:
    """The bars of ``scan_csv``."""
    return scan_csv(spark, path, key)[0]


def _bars_of(named: DataFrame, key: str) -> DataFrame:
    keys = [c for c in named.columns if c.lower() == key.lower()]
    own = F.upper(F.trim(F.col(f"`{keys[0]}`"))) if keys else F.lit(None).cast("string")
    named = parse_dates(clean_numbers(named, PRICES)).withColumn("symbol", F.coalesce(own, symbol_of_file(F.col("_file"))))
    rest = [c for c in named.columns if c not in {"symbol", "dt", "Date", "_file", *PRICES, *keys}]
    return named.select("symbol", "dt", *[c for c in PRICES if c in named.columns], *rest)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Parquet bars, partitioned by symbol; a list of symbols prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("symbol").isin(symbols)) if symbols else df


def last_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("dt").alias("latest"))


def symbol_master(spark: SparkSession, entries: list[str]) -> DataFrame:
    """Listed symbols: trimmed, upper case, with a known exchange suffix, each once in its first place."""
    return universe(spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "i int, entry string"))


def universe(rows: DataFrame) -> DataFrame:
    """The same from a table of places and entries (i, entry)."""
    full = F.upper(F.trim("entry"))
    known = rows.withColumn("SYMBOL_EXCHANGE", full).filter(full.endswith(".NS") | full.endswith(".BO"))
    first = known.groupBy("SYMBOL_EXCHANGE").agg(F.min("i").alias("i"))
    exchange = F.when(F.col("SYMBOL_EXCHANGE").endswith(".NS"), "NSE").otherwise("BSE")
    return first.select("i", F.regexp_replace("SYMBOL_EXCHANGE", r"\.(NS|BO)$", "").alias("SYMBOL"), "SYMBOL_EXCHANGE", exchange.alias("EXCHANGE"))


def of_exchange(master: DataFrame, exchange: str) -> DataFrame:
    return master.filter(F.col("EXCHANGE") == exchange)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON state such as progress or a checkpoint's metadata."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_symbol_csv(spark: SparkSession, folder: str, symbol: str, names: tuple[str, ...] = ("{symbol}.csv", "{symbol}.NS.csv", "{symbol}.BO.csv")) -> DataFrame:
    """The bars of one symbol from the first of its file names that is there."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.format(symbol=symbol)}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read_bars_csv(spark, path.toString()).withColumn("symbol", F.lit(symbol))
    raise FileNotFoundError(f"no file of {symbol} in {folder}")


def index_history(quotes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Quotes of index symbols (symbol, dt, Close) as the long table of indices (dt, name, close), by their names; symbols without a name go."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in (pair[0].upper(), pair[1])])
    return quotes.select("dt", F.try_element_at(table, F.upper("symbol")).alias("name"), F.col("Close").alias("close")).filter("name IS NOT NULL AND close IS NOT NULL")


def read_sequences(spark: SparkSession, path: str, stage: str, cutoff: str, seed: int = 0) -> DataFrame:
    """Cached training sequences of a stage and cutoff in an order that the seed decides: rows are dealt to tasks and sorted within them by a hash of the seed and their place."""
    rows = spark.read.parquet(path).filter((F.col("stage") == stage) & (F.col("cutoff") == cutoff))
    mixed = rows.withColumn("_order", F.xxhash64(F.lit(seed), "symbol", "i"))
    return mixed.repartition("_order").sortWithinPartitions("_order").drop("_order")
