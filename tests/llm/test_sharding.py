from collections import Counter
from math import comb

import numpy as np

from pyspark.sql import functions as F

from tests.llm.helpers import documents, table
from tidemark.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def draw(spark, good, bad, sample, n):
    df = spark.range(n).select(hypergeometric(F.lit(good), F.lit(bad), F.lit(sample), F.lit(5), F.col("id")).alias("k"))
    return Counter(r["k"] for r in df.collect())


def close_to_exact(got, good, bad, sample):
    n = sum(got.values())
    total, chi, kinds, rest_e, rest_o = comb(good + bad, sample), 0.0, 0, 0.0, 0
    for k in range(max(0, sample - bad), min(good, sample) + 1):
        e = n * comb(good, k) * comb(bad, sample - k) / total
        if e < 8:
            rest_e, rest_o = rest_e + e, rest_o + got.get(k, 0)
            continue
        chi, kinds = chi + (got.get(k, 0) - e) ** 2 / e, kinds + 1
    if rest_e > 4:
        chi, kinds = chi + (rest_o - rest_e) ** 2 / rest_e, kinds + 1
    return chi < kinds + 5 * (2 * kinds) ** 0.5


def test_draws_are_hypergeometric(spark):
    for good, bad, sample in ((7, 9, 5), (60, 40, 30), (300, 900, 400), (900, 300, 800), (5, 4000, 700), (40, 40, 79)):
        assert close_to_exact(draw(spark, good, bad, sample, 6000), good, bad, sample), (good, bad, sample)
    assert draw(spark, 0, 5, 3, 5) == {0: 5} and draw(spark, 5, 0, 3, 5) == {3: 5} and draw(spark, 5, 5, 10, 5) == {5: 5} and draw(spark, 5, 5, 0, 5) == {0: 5}


def test_matrix_has_the_margins(spark):
    counts = [(i, (i * 37) % 91) for i in range(40)]
    n = sum(c for _, c in counts)
    sizes = [n // 7 + (s < n % 7) for s in range(7)]
    rows = communication_matrix(spark.createDataFrame(counts, "id long, n long"), sizes, seed=3, fan=6).collect()
    assert {r["id"]: sum(r["out"]) for r in rows} == dict(counts)
    assert [sum(r["out"][s] for r in rows) for s in range(7)] == sizes
    assert all(min(r["out"]) >= 0 for r in rows)


def test_shards_are_whole_and_even(spark):
    rows = documents(n=70) + documents(n=70)[:20]
    df = table(spark, rows, parts=5).withColumn("shard", F.lit("own")).withColumn("id", F.lit(1)).withColumn("r1", F.lit(2.0))
    out = shuffle_into_shards(df, 4, seed=2).collect()
    assert sorted(str(r[:5]) for r in out) == sorted(str(x) for x in [tuple(r) for r in table(spark, rows).collect()])
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2, 3}
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert {(r["id"], r["r1"]) for r in out} == {(1, 2.0)}


def test_order_is_shuffled_and_empty_tables_stay_empty(spark):
    out = {r["id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(spark.range(4000, numPartitions=8), 4, seed=9).collect()}
    assert abs(sum(s == 0 for i, (s, _) in out.items() if i < 500) - 125) < 50
    front = [i for i, (_, slot) in out.items() if slot < 100]
    assert abs(sum(front) / len(front) - 2000) < 250
    assert shuffle_into_shards(spark.range(0), 4).count() == 0
    assert shuffle_into_shards(spark.range(2), 4).count() == 2


def test_places_in_different_partitions_are_independent(spark):
    """A row's shard, slot and partition say nothing of the row at the same place of any other partition."""
    parts, n = 4, 8000
    rows = shuffle_into_shards(spark.range(parts * n, numPartitions=parts), 4, seed=5).collect()
    shard, slot = np.empty(parts * n), np.empty(parts * n)
    for r in rows:
        shard[r["id"]], slot[r["id"]] = r["shard"], r["slot"]
    seen = np.concatenate([shard.reshape(parts, n), slot.reshape(parts, n)])
    off = np.corrcoef(seen) - np.eye(2 * parts)
    assert np.abs(off).max() < 5 / n**0.5


def test_small_tables_are_permuted_uniformly(spark):
    """All assignments of six rows to three shards are as frequent as a uniform permutation makes them (90 of them), and slots within a shard too."""
    n = 2700
    id_, tries = F.col("id") % 6, F.floor(F.col("id") / 6)
    counts = Counter()
    for seed in range(3):
        # one table of many small ones: rows of a group that fall next to each other in the whole order are a permutation of the group
        rows = shuffle_into_shards(spark.range(6 * n, numPartitions=5).select(id_.alias("k"), tries.alias("t")), 7, seed=seed).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["t"], []).append((r["shard"], r["slot"], r["k"]))
        counts.update(tuple(frozenset(k for _, _, k in sorted(g)[i : i + 2]) for i in (0, 2, 4)) for g in groups.values())
    e = 3 * n / 90
    chi = sum((counts[c] - e) ** 2 / e for c in counts) + (90 - len(counts)) * e
    assert len(counts) == 90 and chi < 89 + 5 * (2 * 89) ** 0.5
