"""Personal data against the forms as written, and the graph against a plain version of it."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, documents, table
from tidemark.llm import pii


def luhn(value):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", value))):
        total += int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4)
    return total % 10 == 0


def matches(text):
    """(kind, start, end, value, whether it passes) by the forms."""
    for kind, form in pii.FORMS.items():
        for m in re.finditer(form, text):
            n = len(re.sub("[^0-9]", "", m[0]))
            if kind == "card" and not 14 <= n <= 19:
                continue
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": luhn(m[0]), "phone": 10 <= n <= 15}[kind]
            yield kind, m.start(), m.end(), m[0], ok


def contexts(text, start, end, before, after):
    norm = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("[0-9]+", "0", s.lower())).strip(" ")
    left, right = norm(text[max(before, start - 64) : start]).split(" "), norm(text[end : min(after, end + 64)]).split(" ")
    out = []
    if left[-1]:
        out.append("1|" + left[-1])
        if len(left) > 1:
            out.append("2|" + " ".join(left[-2:]))
        if right[0]:
            out.append(f"b|{left[-1]}|{right[0]}")
    return out


def wilson(good, n):
    if not n:
        return 0
    z, p = 1.96**2, good / n
    return round((p + z / (2 * n) - math.sqrt(z * (p * (1 - p) / n + z / (4 * n * n)))) / (1 + z / n) * 1e6)


def plain(texts):
    """Spans by form and all spans of each text."""
    base, candidates, edges = {}, {}, {}
    for text in set(texts):
        mine = list(matches(text))
        base[text] = sorted((s, pii.KINDS.index(k), e) for k, s, e, _, ok in mine if ok)
        by_kind = defaultdict(list)
        for m in mine:
            by_kind[m[0]].append(m)
        for kind, own in by_kind.items():
            ends = [0, *(m[2] for m in own)]
            for i, (_, s, e, value, ok) in enumerate(own):
                after = own[i + 1][1] if i + 1 < len(own) else len(text)
                for c in contexts(text, s, e, ends[i], after):
                    edges[c, kind, value, ok] = ()
        candidates[text] = []
        runs = [m for m in re.finditer(r"(?<![^ \t\n\x0b\f\r])[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9]*+[0-9]\S*+)*+", text, re.ASCII)]
        for i, m in enumerate(runs):
            if len(m[0]) > 128:
                continue
            lead = len(re.match("[^A-Za-z0-9+(:]*", m[0])[0])
            value = re.sub("[^A-Za-z0-9:]+$", "", m[0][lead:])
            s = m.start() + lead
            e = s + len(value)
            n = len(re.sub("[^0-9]", "", value))
            may = tuple(k for k, (form, least, most) in pii.SHAPES.items() if re.search(form, value, re.ASCII) and least <= n <= most)
            if not value or len(value) > 64 or not may or any(a < e and b > s for _, a, b, _, _ in mine):
                continue
            candidates[text].append((s, e, value))
            before, after = runs[i - 1].end() if i else 0, runs[i + 1].start() if i + 1 < len(runs) else len(text)
            for c in contexts(text, m.start(), m.end(), before, after):
                edges[c, "?", value, None] = may
    taken = {}
    for _ in range(pii.ROUNDS):
        sums = defaultdict(lambda: defaultdict(float))
        for (c, kind, value, ok), _may in edges.items():
            as_kind = taken.get(value) if kind == "?" else kind if ok else None
            w = 1.0 if kind != "?" else 0.5 if as_kind else 0.1
            sums[c]["all"] += w
            sums[c][as_kind] += w
        score = defaultdict(int)
        for (c, kind, value, _), may in edges.items():
            for k in may if kind == "?" else ():
                if (trust := wilson(sums[c][k], sums[c]["all"])) >= 500_000:
                    score[value, k, c[0]] += -round(math.log(1 - min(trust, 999_999) / 1e6) * 1e6)
        best = defaultdict(dict)
        for (value, k, _), n in score.items():
            best[value][k] = max(best[value].get(k, 0), n)
        more = {v: max(s, key=lambda k, s=s: (s[k], -pii.KINDS.index(k))) for v, s in best.items() if max(s.values()) >= -round(math.log(0.2) * 1e6)}
        if not more:
            break
        taken = more | taken
    out = {}
    for text in base:
        added = [(s, pii.KINDS.index(taken[v]), e) for s, e, v in candidates[text] if v in taken]
        out[text] = base[text], sorted(base[text] + added), len(added)
    return out


def words(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def compare(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("key", F.lit(1)).repartition(3)
    got, want = {r["doc_id"]: r for r in pii.scan(df).collect()}, plain([t or "" for t in texts])
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base, every, n = want[t or ""]
        assert got[i]["spans"] == words(every), repr(t)[:200]
        assert got[i]["base_sha256"] == hashlib.sha256(words(base).encode()).hexdigest() and got[i]["n_added"] == n and got[i]["key"] == 1
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == k for b in base) for k in range(4)]
    return got


ODD = [
    None, "", "a@b.c@d.e", "a@b.c_x@d.e", "a@b@c.d", "@a.b", "x@y", "x@-.-", "é.a@b.c", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1", "001.02.3.255", "99999999999999999999.1.1.1", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111111111112", "4111  1111 1111 1111", "x4111111111111111x 5", "5 - 4111111111111111", "4111111111111111 4111111111111111",
    "+1 (555) 555-0100", "+1 2", "+49.30.1234567 ", "+1+1 (555) 555-0100", "+1 (555) 555-0100 +", "+123456789012345678", "😀 a@b.co 漢 1.2.3.4\n+49 30 1234567", "1.2.3.4@5.6.7.8", "+41111111111111111",
]


def test_forms(spark):
    rng = random.Random(6)
    texts = [*ODD, *(t for _, t, *_ in documents(3))]
    for _ in range(400):
        texts.append("".join(rng.choice(["1", "2", "55", ".", "-", " ", "+", "@", "a", "(", ")", "4111111111111111", "é", "\n", "_", "b.c"]) for _ in range(rng.randint(1, 30))))
    compare(spark, texts)


def test_long_texts_take_linear_time(spark):
    n = 300_000
    texts = ["a" * n, "1" * n, "1." * n, "a@" * n, "a." * n + "@", "+1" + "(" * n, "1 " * n, "@a" + ".a" * n, "-" * n + "@" + " 1@" * 1000, "x" * n + "9", ("12 ab@cd.ef " * 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in pii.scan(df).collect()}
    assert got[10]["n_email"] == 5000 and got[7]["n_email"] == 0 and got[2]["n_ip"] == n // 4


def test_contexts_find_unseen_identifiers(spark):
    """Numbers without a country's code after the words that numbers with one follow; a number of the same form elsewhere isn't one, nor is one after a word that anything follows."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"{rng.choice(['please', 'do', 'just'])} call us: +49 30 {digits(7)} today" for _ in range(40)]
    texts += [f"{rng.choice(['or', 'now'])} call us: (030) {digits(7)} soon" for _ in range(8)]
    texts += [f"invoice number {digits(9)} of today" for _ in range(10)] + [f"host at 10.0.{i}.7 up" for i in range(25)] + ["host at fe80:0:0:12:ab:0:0:1 up"]
    texts += [f"seen {x} there" for i in range(30) for x in (f"10.1.{i}.1", f"+49 40 {digits(7)}", f"040 {digits(6)}")]
    texts += texts[:5] * 20
    got = compare(spark, texts)
    added = {texts[i] for i, r in got.items() if r["n_added"]}
    assert added == {t for t in texts if "(030)" in t or "fe80" in t}
    assert all("phone:" in r["spans"] for i, r in got.items() if "(030)" in texts[i])


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(None, "a@b.cd", None, None, 1), (None, "a@b.cd", None, None, 1)]])
def test_few_and_none(spark, rows):
    out = pii.scan(table(spark, rows, SCHEMA)).collect()
    assert len(out) == len(rows) and all(r["n_email"] == (len(rows) == 2) for r in out)


def test_no_python_in_the_plan(spark):
    df = pii.scan(spark.createDataFrame([(1, "a@b.cd call +49 30 1234567")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
