"""Small tables with the hard cases, and plain versions to hold the operators against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))


def documents(seed=1, n=60):
    """Copies, near copies, shared passages, nulls in every column, empty and long texts, other scripts."""
    rng = random.Random(seed)
    shared = [words(rng, 40) for _ in range(3)]
    base = words(rng, 80)
    texts = [None, "", "   ", "one", "two words", "Ünï côdé ß 漢字 😀 " * 30, "a" * 700, "x \t\n" * 300, words(rng, 3000), base, base, base + " end", base.replace("a", "b", 1), shared[0], "\x00\x01 odd", "<|endoftext|> special"]
    while len(texts) < n:
        t = words(rng, rng.randint(1, 120))
        if rng.random() < 0.4:
            cut = rng.randint(0, len(t))
            t = t[:cut] + " " + rng.choice(shared)[rng.randint(0, 60) :] + " " + t[cut:]
        texts.append(t)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


def table(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def collect(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
