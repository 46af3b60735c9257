"""Repairs against a plain search of all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair
from tidemark.llm.queries import op12_repair_of

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damage(rows):
    out = {}
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text = (" " if x is None else x for x in (role, text))
        x = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(c, [])
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            role = "user" if x == 4 else role
            mine += [(turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], turn, role, text)] * (2 if x == 3 else 1)
    return {c: [r[3:] for r in sorted(t, key=lambda r: r[:3])] for c, t in out.items()}


def search(rows):
    """(cost, audit, repaired rows) of the best edits, from the last row back. ``rows``: (role, text, must go, truncated)."""

    @lru_cache(None)
    def best(i, state, put=0):
        found = []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        full = {"u": "user", "a": "assistant"}[after]
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, gone, cut = rows[i]
            cost, audit, left = best(i + 1, state)
            found.append((cost + 4, "D" + audit, left))
            if not gone:
                if role[:1] == after or role[:1] == "s" and state == "":
                    cost, audit, left = best(i + 1, role[0])
                    found.append((cost + 3 * cut, "K" + audit, ((role, text), *left)))
                cost, audit, left = best(i + 1, after)
                found.append((cost + 3 + 3 * cut, "R" + audit, ((full, text), *left)))
        if put < 3:
            cost, audit, left = best(i, after, put + 1)
            found.append((cost + 3, "I" + audit, ((full, ""), *left)))
        return min(found, default=(10**9, "", ()), key=lambda x: x[:2])

    return best(0, "")


def plain(rows):
    out = []
    for c, mine in damage(rows).items():
        seen, kinds, faults = set(), [], [0, 0, 0]
        for _, role, text in mine:
            bare = text.encode().rstrip(b" \t\n\x0b\x0c\r").decode()
            blank, again = bare == "", (role, text) in seen
            cut = not blank and bare[-1] not in ".!?"
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                faults[fault] += 1
            kinds.append((role, text, blank or again, cut and not (blank or again)))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, audit, left = search(tuple(kinds))
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_the_search(spark, seed):
    rng, rows = random.Random(seed), []
    for c in range(250):
        for turn in range(rng.randint(0, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = rng.choice([None, "", " \n", "Yes.", "No!", "cut off", "why? ", "a.b", "漢。", "é."])
            rows.append((c, rng.choice([turn, turn, turn, None, turn + 3]), role, text))
    rows += [(None, t, "user", "Hm.") for t in range(4)] + [(-5, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(120)] + rows[3:6]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit(1)).withColumn("head", F.lit("clash")).repartition(3)
    assert result(op12_repair_of(df)) == plain(rows)


def test_few_and_none(spark):
    assert result(op12_repair_of(spark.createDataFrame([], SCHEMA))) == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = result(op12_repair_of(spark.createDataFrame([(dropped, 0, "user", "x")], SCHEMA)))
    assert row == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_kinds_in_blocks(seed):
    """Auctions over all kinds of rows, and with blocks so small that prices are found again."""
    rng = random.Random(seed)
    for _ in range(150):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randint(0, 14)))
        rows = tuple(("suax"[k // 3], "", k % 3 == 1, k % 3 == 2) for k in kinds)
        assert repair.cheapest(kinds) == repair.cheapest(kinds, 3) == search(rows)[:2]


def test_prices_are_dual():
    """No price exceeds an arc's cost plus the price at its end."""
    rng, after = random.Random(0), (0, 3, 3, 0)
    for _ in range(500):
        kind = rng.randrange(12)
        price, tight = repair.layer(kind, after)
        for n in range(4):
            ends = [cost + (after[to] if out else price[to]) for _, cost, out, to in repair.arcs(kind, n)]
            assert price[n] == min(ends)
        after = tuple(p - min(price) for p in price)


def test_a_long_conversation():
    kinds = bytes(random.Random(5).choices(range(12), k=200_000))
    cost, audit = repair.cheapest(kinds)
    assert len(audit.replace("I", "")) == len(kinds) and cost > 0
