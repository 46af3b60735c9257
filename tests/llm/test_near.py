"""SimHash clusters, one-permutation fingerprints, connected components."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import collect, components, documents, table, words
from tidemark.llm import minhash, simhash
from tidemark.llm.common import mix64
from tidemark.llm.near import named_groups as groups
from tidemark.llm.components import components as spark_components


def plain_simhash(text):
    """As the rule is told, one bit at a time."""
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_rule():
    for r in documents():
        assert simhash.fingerprint(r[1]) & (2**64 - 1) == plain_simhash(r[1])


def test_links_and_clusters_are_all(spark):
    rng = random.Random(4)
    prints = {0, 1, 7, 15, 2**63, 2**63 | 3, 2**64 - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                p ^= 1 << b
    signed = [p - 2**64 if p >= 2**63 else p for p in sorted(prints)]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert all({(r["a"], r["b"]) for r in simhash.links(frame, parts=k).collect()} == want for k in (5, 9))
    assert [simhash.parts_for(n) for n in (10, 10**6, 10**9, 10**11)] == sorted(simhash.parts_for(n) for n in (10, 10**6, 10**9, 10**11))
    rows = [(i, p) for i, p in enumerate(signed + signed[:10])]
    out = collect(simhash.clusters(spark.createDataFrame(rows, "doc_id long, fp long")))
    links = [(i, j) for i, a in rows for j, b in rows if i < j and bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert {i: r["component_id"] for i, r in out.items()} == components([i for i, _ in rows], links)


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(8)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("d", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))))
    for r in df.collect():
        counts = [[bin(x >> 2 * i & 3).count("1") for i in range(32)] for x in (r["a"], r["b"])]
        assert r["d"] == sum(abs(p - q) for p, q in zip(*counts, strict=True)) <= bin(r["a"] ^ r["b"]).count("1")


def test_documents_with_hard_rows(spark):
    rows = documents()
    rows += [rows[9], (None, rows[9][1], None, None, None), (500, None, None, None, None)]
    prints = simhash.fingerprints(table(spark, rows).withColumn("fp", F.lit("old")), keep_text=False)
    out = simhash.clusters(prints).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[0] == by[1] == by[2] == by[500] == {0} and by[9] == by[10] == by[None] == {9}
    assert simhash.clusters(simhash.fingerprints(table(spark, []))).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 4), (4, 3)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = {r["node"]: r["component"] for r in spark_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == components(nodes, links)
    assert spark_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_minhash(hashes, bins, bits):
    """One hash at a time: bins, then borrowing."""
    shift = 64 - (bins - 1).bit_length()
    least = {}
    for h in hashes:
        b, v = h >> shift, h & ((1 << shift) - 1)
        least[b] = min(v, least.get(b, v))
    out = []
    for b in range(bins):
        attempt, at = 0, b
        while at not in least:
            attempt += 1
            at = int(mix64(np.array([(b + attempt * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) >> shift
        out.append(least[at] & ((1 << bits) - 1))
    return out


def test_bins_are_the_rule():
    rng = random.Random(6)
    make = minhash.Fingerprinter(bins=32, bits=4, size=3)
    texts = [words(rng, n) for n in (1, 2, 3, 4, 10, 200)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    low, some = make.bins_of(data, offsets)
    assert some.all()
    from tidemark.llm.common import shingle_hashes, word_spans

    starts, ends, rows = word_spans(data, offsets)
    hashes, at = shingle_hashes(make._hasher.spans(data, starts, ends), rows, len(texts), 3)
    for i in range(len(texts)):
        assert low[i].tolist() == plain_minhash([int(h) for h in hashes[at == i]], 32, 4)


def test_likeness_is_near_jaccard():
    rng = random.Random(12)
    make = minhash.Fingerprinter()
    errors = []
    for _ in range(40):
        w = words(rng, 400).split()
        other = list(w)
        cut = rng.randint(0, 400)
        other[cut:] = words(rng, 400 - cut).split() if cut < 400 else []
        a, b = " ".join(w), " ".join(other)
        data, offsets = np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a), len(a) + len(b)])
        low, some = make.bins_of(data, offsets)
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, other)]
        errors.append(make.likeness(low[:1], some[:1], low[1:], some[1:])[0] - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_next_and_edited(spark):
    rows = documents()
    df = table(spark, rows).withColumn("part", F.lit("own")).withColumn("n_chars", F.lit("old")).withColumn("kind", F.lit(9))
    out = collect(minhash.with_next(df, keep_text=True, range_bytes=900))
    assert all((r["part"], r["kind"], r["text"], r["source"]) == ("own", 9, rows[i][1], rows[i][3]) for i, r in out.items())
    assert "text" not in minhash.with_next(df).columns
    order = sorted(rows, key=lambda r: -r[0])
    prints = {r["doc_id"]: r["fingerprint"] for r in minhash.fingerprints(table(spark, rows).withColumn("fingerprint", F.lit(0))).collect()}
    assert len(out) == len(rows)
    for k, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        assert out[i]["n_chars"] == len(text)
        edited = text[: len(text) - half] + after[:half]
        assert out[i]["edited_text"] == edited and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert out[i]["fingerprint"] == prints[i]
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    assert out[9]["fingerprint"] == out[10]["fingerprint"] and out[10]["near_next"] == 1.0
    assert out[2]["near_next"] == out[1]["near_next"] == 1.0 and out[0]["fingerprint"] == "" and out[3]["near_next"] == 0.0


def test_next_of_few_rows(spark):
    assert minhash.with_next(table(spark, [])).count() == 0
    one = minhash.with_next(table(spark, [(4, "ab cd", None, None, None)]), keep_text=True).collect()
    assert len(one) == 1 and one[0]["edited_text"] == "ab ab" and one[0]["near_next"] == 1.0
    ties = minhash.with_next(table(spark, [(4, "b", None, None, None), (4, "a", None, None, None), (None, "zz", None, None, None), (4, "b", None, None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in ties) and len(ties) == 4
    # one id, or none, with most of the rows: they are many ranges, and each row still has one follower
    many = [(4, f"text {i % 7} of one id", None, None, None) for i in range(300)] + [(None, "no id", None, None, None)] * 100 + [(9, "first", None, None, None)]
    out = minhash.with_next(table(spark, many, parts=5), range_bytes=200).collect()
    assert len(out) == 401 and sum(r["near_next"] == 1.0 for r in out) >= 401 - 7 - 3


def test_groups_at_a_similarity(spark):
    """Copies with words changed here and there are found from 0.85 on; texts that share less than 0.6 are left alone."""
    rng = random.Random(21)
    rows, alike = [], []
    for _ in range(60):
        base = words(rng, rng.randint(80, 300)).split()
        first = len(rows)
        rows.append(" ".join(base))
        for share in (0.003, 0.01, 0.015, 0.06):
            other = list(base)
            for k in rng.sample(range(len(base)), int(share * len(base))):
                other[k] = words(rng, 1)
            rows.append(" ".join(other).upper() if share == 0.01 else " ".join(other))
        alike += [(first, first + k) for k in range(1, 5)]
    rows += [None, "", "one", "one", "x " * 3000]
    df = table(spark, [(i, t, None, None, None) for i, t in enumerate(rows)])
    out = {r["doc_id"]: r["component"] for r in groups(df).collect()}
    assert set(out) == set(range(len(rows)))
    sets = [set(zip(*((t or "").lower().split()[k:] for k in range(5)), strict=False)) for t in rows]
    near = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert all(out[a] == out[b] for a, b in alike if near(a, b) >= 0.85)
    same = [(a, b) for a in range(300) for b in range(a) if out[a] == out[b]]
    prints = [simhash.fingerprint(t) & (2**64 - 1) for t in rows]
    assert all(near(a, b) >= 0.55 or bin(prints[a] ^ prints[b]).count("1") <= 6 for a, b in same)
    assert out[300] == out[301] == 300 and out[302] == out[303] == 302 and out[304] == 304
    assert groups(table(spark, [])).count() == 0


def exact_groups(rows, prints):
    """Components of all pairs alike by 0.8 in their shingles, or within three bits."""
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in rows]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = [(b, a) for a in range(len(rows)) for b in range(a) if near(a, b) or bin(prints[a] ^ prints[b]).count("1") <= 3]
    return components(range(len(rows)), links), links


def test_pairs_in_crowded_cells(spark):
    """Texts of the same words in other orders, whose word counts are alike, with near copies whose ids lie between those of others."""
    rng = random.Random(31)
    vocabulary = words(rng, 300).split()
    texts = [rng.sample(vocabulary, 300) for _ in range(60)]
    rows = [" ".join(t) for t in texts]
    for t in texts:
        other = list(t)
        for k in rng.sample(range(300), 5):
            other[k] = words(rng, 1)
        rows.append(" ".join(other))
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [rows[k] for k in order]
    out = {r["doc_id"]: r["component"] for r in groups(table(spark, [(i, t, None, None, None) for i, t in enumerate(rows)])).collect()}
    want, links = exact_groups(rows, [plain_simhash(t) for t in rows])
    assert len(links) >= 60 and out == want


def test_appended_and_truncated_copies(spark):
    """Near copies by a passage added or cut off, from a similarity of 0.8 on."""
    rng = random.Random(32)
    rows, links = [], []
    for _ in range(60):
        base = words(rng, rng.randint(80, 300)).split()
        n = len(base)
        more = lambda share, n=n: words(rng, int(share * n)).split()
        copies = [base + more(0.22), more(0.22) + base, base[: n // 2] + more(0.15) + base[n // 2 :], base[: int(0.84 * n)], base[int(0.84 * n) :]]
        links += [(len(rows), len(rows) + k) for k in range(1, 6)]
        rows += [" ".join(t) for t in (base, *copies)]
    out = {r["doc_id"]: r["component"] for r in groups(table(spark, [(i, t, None, None, None) for i, t in enumerate(rows)])).collect()}
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in rows]
    links = [(a, b) for a, b in links if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) >= 200 and all(out[a] == out[b] for a, b in links)


def test_the_similarity_is_exact(spark):
    """Pairs a little above and a little below 0.8: the groups are those of the exact similarities."""
    rng = random.Random(33)
    rows = []
    for k in range(240):
        base = words(rng, 204).split()
        rows += [" ".join(base), " ".join(base + words(rng, 42 + k % 16).split())]
    out = {r["doc_id"]: r["component"] for r in groups(table(spark, [(i, t, None, None, None) for i, t in enumerate(rows)])).collect()}
    want, links = exact_groups(rows, [plain_simhash(t) for t in rows])
    assert 120 <= len(links) <= 160 and out == want
