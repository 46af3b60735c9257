"""The prefix trie against one built turn by turn in memory."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import trie
from tidemark.llm.queries import op11_trie_of

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The contract, word by word."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r[3], r[4]) for r in sorted(t)] for c, t in convs.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        n = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids.get(node, [])) or 1
        saved[node] = (len(members[node]) - 1) * n + sum(saved[k] for k in kids.get(node, []))
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, m in members.items()
    )


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


def conversations(seed, n=150, alphabet=4, longest=9):
    rng = random.Random(seed)
    texts = [None, "", "a b", "x\ty\n", "one two three", "漢 字"][:alphabet] + ["w " * i for i in range(3)]
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for turn in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([None, turn, turn, turn, 0]), rng.choice(["user", "assistant", "", None]), rng.choice(texts)))
    rows += [(None, 1, "user", "lost"), (7, 0, "user", "deep")] + [(61, t, "user", f"t {t}") for t in range(300)]
    rows += rows[5:9]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_built_in_memory(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("depth", F.lit(1)).repartition(3)
    assert result(op11_trie_of(df)) == plain(rows)


def test_copies_and_a_common_first_turn(spark):
    """A hot first turn, a hot conversation, and queues and pieces so small that all spill and part."""
    rows = [(c, t, "user", "hello all" if t == 0 else f"same {t}") for c in range(0, 300, 2) for t in range(5)]
    rows += [(c, t, "user", "hello all" if t == 0 else f"{c % 13} {t}") for c in range(1, 300, 2) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert result(op11_trie_of(df, queue=3, piece=2)) == plain(rows)


def test_few_and_none(spark):
    assert result(op11_trie_of(spark.createDataFrame([], SCHEMA))) == []
    assert result(op11_trie_of(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA))) == []
    for rows in ([(0, None, None, None)], [(25, 0, "user", "a")], [(c, 0, "user", "a") for c in range(21, 40)]):
        assert result(op11_trie_of(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_queue_in_order():
    rng, queue, want = random.Random(3), trie.SpillingQueue(5), {}
    for _ in range(2000):
        m = (rng.randint(-9, 0), bytes([rng.randint(0, 40)]), 1, rng.randint(0, 5), 7)
        queue.push(m)
        old = want.get(m[:2], (0, 0))
        want[m[:2]] = (old[0] + 1, old[1] + m[3])
    got, order = {}, []
    while queue.first() is not None:
        m = queue.pop()
        order.append(m[:2])
        old = got.get(m[:2], (0, 0))
        got[m[:2]] = (old[0] + m[2], old[1] + m[3])
        assert m[4] == 7
    assert order == sorted(order) and got == want and queue.spilled > 64


@pytest.mark.parametrize("text", [None, "", "  ", "a", " a  b\tc\n", "\x0bq\x0c\r", "é　ü", "x" * 500])
def test_words(spark, text):
    assert spark.createDataFrame([(text,)], "text string").select(trie.words_of()).first()[0] == len((text or "").encode().split())
