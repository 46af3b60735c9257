from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm.helpers import documents, table
from tidemark.llm.mixing import mix, pivot, targets, word_count


def plain_targets(sizes, weights, share, most):
    """The rule as told: shares by weight, those above their bound stop there, the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def run(spark, rows, parts=3, **more):
    df = table(spark, rows, parts=parts).withColumn("size", word_count()).withColumn("target", F.lit("old"))
    return mix(df, [3.0, 1.0, 2.0], 1.5, 2.0, **more).collect()


def test_targets_and_sums(spark):
    rows = documents(n=200)
    out = run(spark, rows, block_rows=7, fan=3)
    assert len(out) == len(rows)
    sizes, taken, most, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["size"] == len((r["text"] or "").encode().split()) if r["text"] is None or r["text"].isascii() else True
        assert 0 <= r["copies"] <= 2
        s = r["source"]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        most[s] = max(most[s], r["size"])
        target[s] = r["target"]
    want = plain_targets(sizes, [3, 1, 2], 1.5, 2.0)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= most[s]
    assert all(r["source_size"] == sizes[r["source"]] for r in out)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = documents(n=150)
    key = lambda out: sorted((r["doc_id"], r["copies"]) for r in out)
    assert key(run(spark, rows, parts=2, block_rows=20)) == key(run(spark, rows, parts=6, block_rows=20))


def test_one_hot_source_of_equal_rows(spark):
    rows = [(1, "same words here", "en", "a", 15)] * 300 + [(i, "x y z", "en", "b", 5) for i in range(2, 40)]
    out = run(spark, rows, block_rows=16, fan=4)
    got = defaultdict(int)
    for r in out:
        got[r["source"]] += r["size"] * r["copies"]
    for s in ("a", "b"):
        assert abs(got[s] - next(r["target"] for r in out if r["source"] == s)) <= 3


def test_no_rows_and_no_words(spark):
    assert run(spark, []) == []
    out = run(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])
    assert len(out) == 2 and all(r["size"] == 0 and r["source_size"] == 0 for r in out)


def test_pivot_keeps_words_and_chances():
    total = [0.0, 0.0, 0.0]
    for k in range(4000):
        p, words = [0.3, 0.6, 0.5], [10.0, 20.0, 7.0]
        before = sum(a * b for a, b in zip(p, words, strict=True))
        bits, left = pivot(p, words, [(k * 0.618 + j * 0.377) % 1 for j in range(3)])
        now = [p[j] if j == left else bits[j] for j in range(3)]
        assert abs(sum(a * b for a, b in zip(now, words, strict=True)) - before) < 1e-9
        total = [a + b for a, b in zip(total, now, strict=True)]
    assert all(abs(t / 4000 - w) < 0.02 for t, w in zip(total, (0.3, 0.6, 0.5), strict=True))


def test_chances_and_equal_rows_in_many_blocks(spark):
    """Long and short documents are repeated as often on average as their source's target asks; rows equal in all columns are spread and rerun alike."""
    rows = [(i, "w " * (1, 10, 40)[i % 3], "en", ("a", "b", "c")[i // 3000], 1) for i in range(9000)] + [(9000, "v " * 10, "en", "a", 1)] * 3000
    table_ = lambda parts: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts).withColumn("size", word_count())
    out = mix(table_(4), [3.0, 1.0, 2.0], 1.5, 2.0, block_rows=400).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["source"], r["size"], r["doc_id"] == 9000].append(r["copies"])
        x = r["target"] / r["source_size"]
        by[r["source"], r["size"], r["doc_id"] == 9000, "x"] = x
    for key in [k for k in by if len(k) == 3]:
        n, x = len(by[key]), by[(*key, "x")]
        assert abs(sum(by[key]) / n - x) < 5 * 0.5 / n**0.5, key
    again = mix(table_(7), [3.0, 1.0, 2.0], 1.5, 2.0, block_rows=400).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in out)


def test_many_sources(spark):
    sizes = {f"host{i:05d}": (i * 7919) % 5000 for i in range(3000)} | {None: 77}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_rows long").repartition(5)
    got = {r["source"]: r["target"] for r in targets(df, [3.0, 1.0, 2.0], 1.5, 2.0).collect()}
    want = plain_targets(sizes, [3, 1, 2], 1.5, 2.0)
    assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes)


def test_sources_of_any_type(spark):
    rows = [(i, "w " * (i % 7 + 1), i % 3 if i % 5 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source int").withColumn("size", word_count())
    out = mix(df, [3.0, 1.0, 2.0], 1.5, 2.0, block_rows=8, fan=2)
    assert out.schema["source"].dataType.simpleString() == "int" and out.count() == 90
    got = {r["source"]: (r["t"], r["w"]) for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("w")).collect()}
    assert len(got) == 4 and all(abs(t - w) <= 7 for t, w in got.values())
