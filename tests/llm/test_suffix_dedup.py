import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, table
from tidemark.llm.bwt import merge, repeats, shard_bwt
from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import dedup


def plain(rows, length):
    """Windows seen before, document by document."""
    seen, out = set(), {}
    for i, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = np.zeros(len(text) + 1, bool)
        for a in range(len(text) - length + 1):
            w = text[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone[:-1].astype(int)]))
        out[i] = (bytes(np.frombuffer(text, np.uint8)[~gone[:-1]]), len(text), int(gone.sum()), int((edges == 1).sum()))
    return out


def test_as_the_plain_version(spark):
    for seed, length, gram, shard, hot, few in ((1, 100, 32, 2000, 10_000, 1 << 14), (3, 40, 8, 1000, 4, 0)):
        rng = random.Random(seed)
        rows = documents(seed, 90)
        rows += [(1000 + i, rows[rng.randint(9, 80)][1] + "tail", "en", "z", 1) for i in range(20)]
        df = table(spark, rows, parts=4).withColumn("kept", F.lit(3)).withColumn("shard", F.lit("s"))
        got = {r["doc_id"]: r for r in dedup(df, length=length, gram=gram, shard_bytes=shard, hot=hot, shard_group=3, few_shards=few).collect()}
        want = plain(rows, length)
        assert set(got) == set(want)
        for i, (kept, n, removed, spans) in want.items():
            assert (bytes(got[i]["kept"]), got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (kept, n, removed, spans), (seed, i)
            assert got[i]["shard"] == "s" and got[i]["source"] == next(r[3] for r in rows if r[0] == i)


def test_repeated_rows_nulls_and_no_rows(spark):
    text = "abcdefghij" * 30
    rows = [(5, text, "en", "a", 1), (5, text, "en", "a", 1), (None, text, "en", "a", 1), (7, None, None, None, None)]
    out = dedup(table(spark, rows), length=50, gram=16).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"], len(r["kept"])) for r in out) == [(-1, 300, 0), (5, 290, 10), (5, 290, 10), (7, 0, 0)]
    assert dedup(table(spark, [])).count() == 0


def test_merge_gives_the_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        shards = [[bytes(rng.choice(b"ab\x00\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 4))]
        built = [shard_bwt(s) for s in shards]
        base = np.cumsum([0, *[len(b.symbols) for b in built]])
        for depth in (1, 3, 20):
            found = merge(built, depth)
            suffixes = []
            for r in found.rows:
                j = int(np.searchsorted(base, r, side="right") - 1)
                b, k = built[j], r - base[j]
                suffixes.append(shards[j][b.strings[k]][b.offsets[k] :])
            keys = [[c + 1 for c in x[:depth]] + [0] * (len(x) < depth) for x in suffixes]
            assert keys == sorted(keys)
            for x, y, common in zip(suffixes, suffixes[1:], found.lcp[1:], strict=False):
                n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                assert common == min(n, depth)


def test_repeats_are_the_repeated_strings():
    rng = random.Random(5)
    for _ in range(80):
        shards = [[bytes(rng.choice(b"ab\xff"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 4))]
        strings = [s for x in shards for s in x]
        weights = np.array([rng.choice([1, 1, 2, 5]) for _ in strings])
        for depth in (1, 3, 6):
            seen = {}
            for i, s in enumerate(strings):
                for a in range(len(s) - depth + 1):
                    seen.setdefault(s[a : a + depth], []).append((i, a))
            want = sorted(sorted(v) for v in seen.values() if sum(weights[i] for i, _ in v) > 1)
            got = {}
            for i, a, g in zip(*repeats([shard_bwt(x) for x in shards], weights, depth), strict=True):
                got.setdefault(int(g), []).append((int(i), int(a)))
            assert sorted(map(sorted, got.values())) == want


def test_nothing_goes_but_by_the_merge(spark, monkeypatch):
    """Without the merge's intervals no byte is removed, copies of whole documents included."""
    rows = documents(3, 40)
    df = table(spark, rows)
    assert sum(r["n_removed"] for r in dedup(df).collect()) > 0
    none, judge = np.zeros(0, np.int64), suffix_dedup._judge

    def without(length, forward=False):
        def run(t):
            merged, suffix_dedup.repeats = suffix_dedup.repeats, lambda *a: (none, none, none)
            try:
                return judge(length, forward)(t)
            finally:
                suffix_dedup.repeats = merged

        return run

    monkeypatch.setattr(suffix_dedup, "_judge", without)
    assert sum(r["n_removed"] for r in dedup(df).collect()) == 0
