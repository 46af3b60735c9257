"""Operators on hand-written rows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import backtest, clean, joins, mapping, models, resample, signals, splits
from tidemark.operators.features import finish
from tidemark.sources import readers, sinks
from tidemark.streaming import incremental

BARS = "symbol string, dt date, Open double, High double, Low double, Close double, Volume double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def bars(spark, n=300, symbols=("A", "B")):
    rows = [(s, day(i), 100 + i * 0.1, 101 + i * 0.1 + i % 3, 99 + i * 0.1 - i % 2, 100 + 0.1 * i + (i % 7) * 0.2, float(i % 5 + 1)) for s in symbols for i in range(n)]
    return spark.createDataFrame(rows, BARS)


def test_names_numbers_and_dates(spark):
    df = spark.createDataFrame([("2024-01-05", "1.5%", "3,000", "x")], "` date ` string, open string, volume string, high string")
    out = clean.parse_dates(clean.clean_numbers(clean.standardise_columns(df), ["Open", "Volume", "High", "Low"])).first()
    assert (out["dt"], out["Open"], out["Volume"], out["High"]) == (day(4), 1.5, 3000.0, None)


def test_fills_and_bounds(spark):
    df = spark.createDataFrame([("A", day(i), v) for i, v in enumerate([None, 2.0, None, float("nan"), float("inf"), 5e9])], "symbol string, dt date, x double")
    assert [r["x"] for r in clean.fill(df.filter("dt <= '2024-01-03'"), ["x"]).orderBy("dt").collect()] == [2.0, 2.0, 2.0]
    assert [r["y"] for r in df.select("dt", clean.bounded(F.col("x")).alias("y")).orderBy("dt").collect()] == [None, 2.0, None, None, None, 1e6]
    done = finish(df.withColumn("Close", F.lit(1.0)), ["x"], causal=True).orderBy("dt").collect()
    assert [r["x"] for r in done] == [None, 2.0, 2.0, 2.0, 2.0, 5e9]
    assert clean.usable_columns(df.withColumn("none", F.lit(None).cast("double")), ["x", "none", "missing"]) == ["x"]


def test_windows_of_time(spark):
    df = bars(spark, 400, ("A",))
    cut = str(day(399))
    assert clean.stage_window(df, "yearly", cut).count() == 400
    assert clean.stage_window(df, "weekly", cut).count() == 181
    assert clean.stage_window(df, "unknown", cut).count() == 91
    assert clean.until(df, str(day(9))).count() == 10
    days = spark.createDataFrame([(dt.date(2024, 3, d),) for d in (7, 8, 9, 10)], "d date").select(clean.next_business_day(F.col("d")).alias("n")).collect()
    assert [r["n"].day for r in days] == [8, 11, 11, 11]


def test_sectors_levels_and_buckets(spark):
    pairs = [("Technology", "Software"), ("Banking", "Financial Services"), ("intermediate goods", ""), ("Consumer Durables", "x"), (None, None)]
    df = spark.createDataFrame(pairs, "s string, i string")
    assert [r[0] for r in df.select(mapping.sector_of(F.col("s"), F.col("i"))).collect()] == ["IT", "BANKING", "MEDIA", "FMCG", "GENERIC"]
    rows = [("Private Bank", "x", "NIFTY_PRIVATE_BANK"), ("x", "public bank", "NIFTY_PSU_BANK"), ("bank", "x", "BANKNIFTY"), ("x", "it services", "NIFTY_IT"), ("Oil", "x", "NIFTY_OIL_GAS"), ("x", "y", "NIFTY50"), (None, None, "NIFTY50"), ("consumer durables", "food", "NIFTY_CONSUMER_DURABLES")]
    got = spark.createDataFrame(rows, "s string, i string, want string").select(mapping.index_of(F.col("s"), F.col("i")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    levels = spark.createDataFrame([(v,) for v in (0.1, 0.25, 0.35, 0.5, 0.8)], "v double").select(mapping.level_of(F.col("v"))).collect()
    assert [r[0] for r in levels] == ["VERY_LOW", "LOW", "MEDIUM", "HIGH", "VERY_HIGH"]
    b = spark.createDataFrame([("VERY_LOW", "BANKING"), ("VERY_HIGH", "CONSUMER_DURABLES"), ("VERY_HIGH", "GENERIC"), ("VERY_LOW", "GENERIC"), ("LOW", "GENERIC")], "l string, s string")
    assert [r[0] for r in b.select(mapping.bucket_number(F.col("l"), F.col("s"))).collect()] == ["BUCKET_1", "BUCKET_75", "BUCKET_76", "BUCKET_77", "BUCKET_78"]
    caps = spark.createDataFrame([(None,), (0.0,), (2e12,), (6e11,), (1e9,)], "c double").select(mapping.cap_index(F.col("c"))).collect()
    assert [r[0] for r in caps] == ["NIFTY_MIDCAP", "NIFTY_MIDCAP", "NIFTY_LARGECAP", "NIFTY_MIDCAP", "NIFTY_SMALLCAP"]
    assert mapping.annual_volatility(bars(spark, 10)).first()["annual_vol"] == 0.3


def test_resample_and_asof(spark):
    rows = bars(spark, 10, ("A",))
    weekly = resample.resample(rows, "weekly").orderBy("dt").collect()
    assert [(r["dt"], r["Volume"]) for r in weekly] == [(day(4), 15.0), (day(11), 15.0)]
    right = spark.createDataFrame([("A", day(2), 1.0, None), ("A", day(5), None, 2.0)], "symbol string, dt date, p double, q double")
    joined = resample.asof_join(rows.select("symbol", "dt"), right, "symbol", "dt", ["p", "q"]).orderBy("dt").collect()
    assert [(r["p"], r["q"]) for r in joined] == [(None, None)] * 2 + [(1.0, None)] * 3 + [(None, 2.0)] * 5
    assert {r["Weekly_RSI"] for r in resample.with_coarse(rows).collect()} == {0.0}


def test_joins(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("A", 2, "x")], "k string, d int, v string")
    new = spark.createDataFrame([("A", 2, "y"), ("B", 1, "y")], "k string, d int, v string")
    assert sorted(map(tuple, joins.upsert(old, new, ["k", "d"]).collect())) == [("A", 1, "x"), ("A", 2, "y"), ("B", 1, "y")]
    registry = spark.createDataFrame([("A", None, "weekly", day(1), "w"), ("A", None, "yearly", day(9), "y"), (None, "K", "daily", day(0), "d"), (None, "L", "odd", day(0), "o")], "symbol string, bucket string, stage string, cutoff date, path string")
    wanted = spark.createDataFrame([("A", "L"), ("A", "K"), ("C", "K"), ("D", "M")], "symbol string, bucket string")
    assert sorted((r["symbol"], r["bucket"], r["path"]) for r in joins.best_checkpoint(wanted, registry).collect()) == [("A", "K", "d"), ("A", "L", "w"), ("C", "K", "d")]


def test_sequences_and_splits(spark):
    rows = bars(spark, 10, ("A",))
    seq = splits.sequences(rows, ["Open", "Close"], 3).orderBy("dt").collect()
    assert len(seq) == 7 and all(len(r["seq"]) == 3 and len(r["seq"][0]) == 2 for r in seq)
    assert seq[0]["seq"][0][0] == 100.0 and seq[0]["i"] == 3
    parts = {r["part"]: r["n"] for r in splits.holdout(bars(spark, 300, ("A",))).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 220, "val": 40, None: 40}
    walk = splits.walk_forward(bars(spark, 1300, ("A",)).select("dt")).orderBy("split_id").collect()
    assert len(walk) == 3 and (walk[1]["split_id"], walk[1]["train_start"], walk[1]["test_end"]) == (1, day(126), day(126 + 1047))
    assert splits.last_rows(bars(spark, 300)).count() == 400 and splits.last_rows(bars(spark, 100)).count() == 0
    smooth = spark.createDataFrame([(0.0,), (1.0,)], "y double").select(splits.smooth(F.col("y")).alias("y")).collect()
    assert [round(r["y"], 6) for r in smooth] == [0.005, 0.995]
    flat = splits.scale(splits.holdout(bars(spark, 300, ("A",)).withColumn("k", F.lit(2.0))), ["k"]).select("k_scaled").distinct().collect()
    assert [r[0] for r in flat] == [0.0]


def test_signals(spark):
    preds = spark.createDataFrame([(f"S{i}", "LOW" if i % 2 else "HIGH", str(i / 10) if i else "bad") for i in range(60)], "symbol string, volatility_class string, predicted_return string")
    out = signals.ranked(preds, 20).collect()
    by = lambda report, cls=None: sorted((r["rank"], r["symbol"]) for r in out if r["report"] == report and (cls is None or r["volatility_class"] == cls))
    assert by("top", "LOW")[0] == (1, "S59") and len(by("top", "LOW")) == 20 and by("bottom", "HIGH")[0] == (1, "S2")
    assert [k for k, _ in by("overall")] == list(range(1, 60)) and by("overall")[0] == (1, "S59")
    rows = spark.createDataFrame([("a", 0.01, 0.02, None, 0.7, 0.5, 100.0), ("b", 0.01, -0.02, 0.01, 0.5, 0.5, 100.0), ("c", -0.01, None, None, 0.2, -1.0, 100.0)], "symbol string, dl_ret double, lgbm_ret double, xgb_ret double, dir_prob double, intensity double, last_close double")
    got = {r["symbol"]: r for r in signals.ensemble(rows).collect()}
    assert got["a"]["action"] == "LONG" and abs(got["a"]["expected_ret_pct"] - 100 * (0.6 * 0.01 + 0.25 * 0.02) / 0.85) < 1e-9 and got["a"]["confidence"] == 0.75
    assert got["b"]["action"] == "NO_TRADE" and got["b"]["confidence"] == 0.25 and got["c"]["action"] == "SHORT" and abs(got["c"]["confidence"] - 0.9) < 1e-12
    v = spark.createDataFrame([("x", 0.7, 0.5, 2.0), ("y", 0.5, -0.5, 0.0)], "symbol string, dir_prob double, intensity double, change double")
    assert {r["symbol"]: (r["verdict"], r["confidence"]) for r in signals.verdict(v).collect()} == {"x": ("BULLISH", 75.0), "y": ("NEUTRAL", 50.0)}


def test_portfolio(spark):
    curve = spark.createDataFrame([(day(i), e, r, 1.0, 1, "BULL" if i < 2 else "BEAR", "LOW_VOL") for i, (e, r) in enumerate([(100.0, 0.0), (110.0, 0.1), (99.0, -0.1), (120.0, 0.2)])], "dt date, equity double, ret double, exposure double, positions int, trend string, vol string")
    m = backtest.metrics(curve).first()
    assert abs(m["total_return"] - 0.2) < 1e-12 and abs(m["MaxDD"] + 0.1) < 1e-12 and m["Daily_Win_Rate"] == 0.5
    regimes = {(r["regime_type"], r["regime"]): r["observations"] for r in backtest.by_regime(curve).collect()}
    assert regimes == {("trend", "BULL"): 2, ("trend", "BEAR"): 2, ("vol", "LOW_VOL"): 4, ("trend_vol", "BULL_LOW_VOL"): 2, ("trend_vol", "BEAR_LOW_VOL"): 2}


def test_models_and_losses(spark):
    rows = spark.createDataFrame([(float(i), float(-i), 0.01 * i - 0.5) for i in range(100)], "a double, b double, y double")
    scored = models.score(models.fit_baseline(rows, ["a", "b"]), rows).orderBy("a").collect()
    assert scored[99]["dir_prob"] > 0.9 > 0.1 > scored[0]["dir_prob"] and scored[99]["predicted_log_return"] > scored[0]["predicted_log_return"]
    own = models.score_with(rows, lambda pdf: pdf.assign(z=pdf.a * 2)[["a", "z"]], "a double, z double").agg(F.max("z")).first()[0]
    assert own == 198.0
    l = models.losses(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "y double, prediction double, label double, prob double")).first()
    assert l["weighted_mse"] == 0 and l["huber"] == 0 and l["focal"] < 1e-6
    # by hand: a spike, errors on both sides of delta, soft labels, a probability of zero
    rows = [(0.04, 0.01, 0.995, 0.8), (-0.5, 0.1, 0.5, 0.3), (0.0, 0.049, 0.005, 0.0)]
    l = models.losses(spark.createDataFrame(rows, "y double, prediction double, label double, prob double")).first()
    assert np.isclose(l["weighted_mse"], ((1.5 + 3.5 * 0.008) * 0.0009 + (1.5 + 3.5 * 0.5**1.5) * 0.36 + 1.5 * 0.049**2) / 3)
    assert np.isclose(l["huber"], (0.5 * 0.0009 / 0.05 + (0.6 - 0.025) + 0.5 * 0.049**2 / 0.05) / 3)
    right = [0.995 * 0.8 + 0.005 * 0.2, 0.5, 0.005 * 1e-7 + 0.995 * (1 - 1e-7)]
    assert np.isclose(l["focal"], np.mean([-0.5 * (1 - t) ** 2 * np.log(t) for t in right]))


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    import gzip

    d = tmp_path / "csv files"
    d.mkdir()
    (d / "AAA.NS.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,9,10,8,9.5,100\n")
    (d / "b +b.csv").write_text('\ufeffdate,Close,Open,High,Low,"Volume",Extra,close\n2024-01-02,1.5,1,2,0.5,"1,000",x,7\n')
    with gzip.open(d / "C_with_nifty50.csv.gz", "wt") as out:
        out.write("VOLUME , Datetime,Adj\n5,2024-01-03,2\n")
    (d / "empty.csv").write_text("")
    (d / "b%are +.csv").write_text("Date,Open\n")
    (d / "other.csv").write_text("name,size\na,1\n")
    (d / "broken.csv").write_bytes(b"\xff\xfe\x80 \x81")
    (d / "bad.csv.gz").write_bytes(b"no gzip")
    (d / "notes.txt").write_text("Date,Open\n1,2\n")
    bars, left = readers.scan_csv(spark, str(d))
    rows = {r["symbol"]: r for r in bars.collect()}
    assert {s: (str(r["dt"]), r["Open"], r["High"], r["Low"], r["Close"], r["Volume"], r["Extra"], r["Adj"]) for s, r in rows.items()} == {
        "AAA": ("2024-01-02", 9.0, 10.0, 8.0, 9.5, 100.0, None, None), "BB": ("2024-01-02", 1.0, 2.0, 0.5, 1.5, 1000.0, "x", None), "C": ("2024-01-03", None, None, None, None, 5.0, None, "2"),
    }
    assert {r["file"].rsplit("/", 1)[-1]: r["reason"] for r in left.collect()} == {"empty.csv": "empty", "b%are +.csv": "no rows", "other.csv": "no known column", "broken.csv": "unreadable", "bad.csv.gz": "unreadable"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "ABC_with_nifty.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,\"1,000\"\n2024-01-03,bad,2,1,1.5,5\n")
    (tmp_path / "csv" / "X-Y.NS.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,1,1\n")
    read = readers.read_bars_csv(spark, str(tmp_path / "csv"))
    rows = sorted((r["symbol"], str(r["dt"]), r["Open"], r["Volume"]) for r in read.fillna(-1.0).collect())
    assert rows == [("ABC", "2024-01-02", 1.0, 1000.0), ("ABC", "2024-01-03", -1.0, 5.0), ("XY", "2024-01-02", 1.0, 1.0)]
    sinks.write_bars(read, str(tmp_path / "bars"))
    back = readers.read_bars(spark, str(tmp_path / "bars"), ["ABC"])
    assert back.count() == 2 and "symbol" in back.columns and str(readers.last_dates(back).first()["latest"]) == "2024-01-03"
    master = readers.symbol_master(spark, [" abc.ns", "ABC.NS", "q.bo", "junk"]).orderBy("i").collect()
    assert [(r["SYMBOL"], r["EXCHANGE"]) for r in master] == [("ABC", "NSE"), ("Q", "BSE")]
    state = spark.createDataFrame([("2024-01-02", ["A"], 1)], "last_update string, processed_stocks array<string>, total_processed int")
    sinks.write_state(state, str(tmp_path / "state"))
    assert readers.read_state(spark, str(tmp_path / "state"), "last_update string, processed_stocks array<string>, total_processed int").first() == state.first()
    preds = spark.createDataFrame([("A", 1.0)], "symbol string, predicted_return double")
    assert sinks.write_predictions(preds, str(tmp_path / "p"), "2024-01-02") and not sinks.write_predictions(preds.limit(0), str(tmp_path / "q"), "x")


def test_incremental_equals_batch(spark, tmp_path):
    src, target, check = (str(tmp_path / x) for x in ("src", "target", "check"))
    first, second = bars(spark, 5, ("A",)), bars(spark, 8, ("A",)).filter(F.col("dt") >= F.lit(day(3))).withColumn("Close", F.lit(7.0))
    for part in (first, second):
        part.write.mode("append").parquet(src)
        q = incremental.ingest(spark, src, BARS, target, check)
        q.awaitTermination()
        assert q.exception() is None
    got = {r["dt"]: r["Close"] for r in incremental.current(spark, target, BARS).collect()}
    want = {r["dt"]: r["Close"] for r in joins.upsert(first, second, ["symbol", "dt"]).collect()}
    assert got == want and len(got) == 8


def test_event_bars_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = incremental.bars_of_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("event_bars").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("event_bars").exceptAll(incremental.bars_of_events(events))
    assert got.count() == 0 and spark.table("event_bars").count() == incremental.bars_of_events(events).count()


def fetch(symbol, start, end):
    if symbol == "BAD":
        raise OSError("no such symbol")
    return [(dt.date.fromisoformat(start), 1.0, 2.0, 0.5, 1.5, float(len(symbol)))]


def test_quotes_source(spark):
    from tidemark.sources.quotes import Quotes

    spark.dataSource.register(Quotes)
    read = spark.read.format("quotes").option("symbols", "a, bb,BAD,a").option("start", "2024-01-02").option("fetch", "tests.test_operators:fetch").load()
    assert sorted((r["symbol"], r["Volume"]) for r in read.collect()) == [("A", 1.0), ("BB", 2.0)]


def test_fits_by_group_and_their_stages(spark):
    import numpy as np

    from tidemark.operators import training

    rng = np.random.default_rng(3)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [(s, d, 101.0, 99.0, 100.0, float(x), float(z)) for s in "ABC" for d, x, z in zip(days, rng.normal(0, 0.02, 400), rng.normal(0, 1, 400), strict=True)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, High double, Low double, Close double, LogRet double, z double")
    made = training.with_targets(bars)
    # labels of the next row: the band is a quarter of the mean range of 2 %, the scale that of the rows before the embargo
    mine = [r[5] for r in rows if r[0] == "A"]
    trained = np.array(mine[: 400 - 60 - 20])
    for r, y in zip(made.filter("symbol = 'A'").orderBy("dt").limit(399).collect(), mine[1:], strict=True):
        assert r["ret"] == y and np.isclose(r["dir"], 0.995 if y > 0.005 else 0.005 if y < -0.005 else 0.5) and np.isclose(r["int"], np.tanh((y - trained.mean()) / (0.8 * (trained.std() + 1e-9))))
    assert [r["n"] for r in made.filter("symbol = 'A'").groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()] == [41, 319, 40]
    members = spark.createDataFrame([("A", "b1", "IT", "LOW"), ("B", "b1", "IT", "LOW"), ("C", "b2", "AUTO", "HIGH")], "symbol string, bucket string, sector string, volatility_class string")
    registry = training.train(made, members, ["LogRet", "z"], "2000-12-31", penalty=5.0)
    got = {(r["symbol"], r["bucket"], r["stage"]): r for r in registry.collect()}
    assert set(got) == {(None, b, "yearly") for b in ("b1", "b2")} | {(s, b, t) for s, b in (("A", "b1"), ("B", "b1"), ("C", "b2")) for t in ("monthly", "weekly", "daily")}
    frame = made.drop("part").toPandas().dropna()
    frame["dt"] = frame["dt"].astype(str)

    def plain(part, prior):
        x = np.column_stack([np.ones(len(part)), part["LogRet"], part["z"]])
        return np.linalg.solve(x.T @ x + 5 * np.eye(3), x.T @ part["ret"].to_numpy() + 5 * prior)

    upto = frame[frame["dt"] <= "2000-12-31"]
    base = plain(upto[upto["symbol"].isin(["A", "B"])], np.zeros(3))
    assert np.allclose(got[None, "b1", "yearly"]["ret"], base)
    for stage, first in (("monthly", "2000-01-01"), ("weekly", "2000-07-04"), ("daily", "2000-10-02")):
        base = plain(upto[(upto["symbol"] == "A") & (upto["dt"] >= first)], base)
        assert np.allclose(got["A", "b1", stage]["ret"], base), stage
    table = training.predict_only(bars, members, registry, ["LogRet", "z"], "2000-12-31").collect()
    assert {r["symbol"]: (r["model_stage_used"], str(r["cutoff_date"])) for r in table} == {s: ("daily", "2000-12-31") for s in "ABC"}
    assert all(0 <= r["dir_prob"] <= 1 and -1 <= r["intensity"] <= 1 for r in table) and len(table[0]) == 17


def test_listings_and_polling(spark, tmp_path):
    from tidemark.sources.listings import Listings

    spark.dataSource.register(Listings)
    read = lambda **o: sorted(map(tuple, spark.read.format("listings").options(**o).load().collect()), key=str)
    assert read(fetch="tests.test_operators:listed", fallback="x.bo, y.ns") == [("AB", "AB.NS", "NSE", "Ab Ltd"), ("X", "X.BO", "BSE", None)]
    assert read(fetch="tests.test_operators:nothing", exchanges="nse") == []
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "symbol string, dt date, Close double"
    spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0)], schema).write.parquet(source)
    query = incremental.ingest(spark, source, schema, target, f"{tmp_path}/state", every="1 second")
    query.processAllAvailable()
    spark.createDataFrame([("A", dt.date(2020, 1, 1), 2.0), ("A", dt.date(2020, 2, 1), 3.0)], schema).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    assert sorted(r["Close"] for r in incremental.current(spark, target, schema).collect()) == [2.0, 3.0]


def listed(exchange):
    if exchange == "BSE":
        raise OSError("not there")
    return [(" ab.ns", "Ab Ltd"), ("AB", "again")]
