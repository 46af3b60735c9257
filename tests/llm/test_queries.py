"""Every query opN over the smallest supplied tables, against a plain version of its contract."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.helpers import components
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near import plain_simhash
from tests.llm.test_suffix_dedup import plain
from tidemark.llm import queries

tokenizers_files = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())


def run(spark, sf_dir, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, sf_dir).collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op1_shards")
    slots = defaultdict(list)
    for i, text, _ in docs:
        data = (text or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[out[i]["shard"]].append(out[i]["slot"])
    assert len(out) == len(docs) and set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, sf_dir, docs):
    out, sizes, taken, most = run(spark, sf_dir, "op2_mix"), defaultdict(int), defaultdict(int), defaultdict(int)
    for i, text, source in docs:
        n = len((text or "").encode().split())
        assert out[i]["size"] == n and 0 <= out[i]["taken"] <= 2 * n
        sizes[source] += n
        taken[source] += out[i]["taken"]
        most[source] = max(most[source], n)
    want = plain_targets(sizes, [3, 1, 2], 1.5, 2.0)
    for i, _, source in docs:
        assert abs(out[i]["target"] - want[source]) < 1e-6 * want[source] and out[i]["source_size"] == sizes[source]
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)


def test_op3(spark, sf_dir, docs):
    out, want = run(spark, sf_dir, "op3_suffix_dedup"), plain(docs, 100)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in out.items()} == {i: (n, gone, spans, sha(kept)) for i, (kept, n, gone, spans) in want.items()}


def test_op4(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op4_quality")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [out[i]["predicted"] == q for i, q in labels.items() if out[i]["held_out"]]
    assert np.mean(held) > 0.85


def test_op4_reads_few_texts_at_once(spark, sf_dir, monkeypatch):
    """4,096 texts a batch, as Spark reads by itself, swell an executor's heap."""
    key, seen, write = "spark.sql.parquet.columnarReaderBatchSize", {}, queries.materialise

    def noted(df, name, keep=False):
        seen[name] = int(spark.conf.get(key))
        return write(df, name, keep)

    monkeypatch.setattr(queries, "materialise", noted)
    before = spark.conf.get(key)
    run(spark, sf_dir, "op4_quality")
    assert seen["features"] <= 256 and spark.conf.get(key) == before

    def broken(df, name, keep=False):
        raise OSError("no room")

    monkeypatch.setattr(queries, "materialise", broken)
    with pytest.raises(OSError):
        run(spark, sf_dir, "op4_quality")
    assert spark.conf.get(key) == before


def test_op5(spark, sf_dir):
    got = {i: tuple(r[c] for c in ("n_sentences", "sentence_ids", "licences")) for i, r in run(spark, sf_dir, "op5_licences").items()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op5_licences"]).df()
    assert got == {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licences"]) for _, r in want.iterrows()}


def plain_media(payload):
    """A payload as silent 48 kHz mono frames with checksums behind a tag and a table, byte by byte; and the feature text."""

    def crc(data):
        out = 0xFFFF
        for bit in "".join(f"{x:08b}" for x in data):
            out = ((out << 1) ^ (0x8005 if (out >> 15) ^ int(bit) else 0)) & 0xFFFF
        return out.to_bytes(2, "big")

    def seven(n):
        return bytes(n >> s & 127 for s in (21, 14, 7, 0))

    kbps = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    frames = []
    for at in range(0, len(payload), 937):
        part = payload[at : at + 937]
        k = min(k for k in range(14) if 3 * kbps[k] - 23 >= len(part))
        head = bytes([0xFF, 0xFA, (k + 1) << 4 | 4, 0xC0])
        frames.append((head + crc(head[2:] + bytes(17)) + bytes(17) + part).ljust(3 * kbps[k], b"\0"))
    text = b"\3payload_bytes\0" + str(len(payload)).encode()
    tag = b"ID3\4\0\0" + seven(len(text) + 10) + b"TXXX" + seven(len(text)) + b"\0\0" + text
    sizes = [len(f) for f in frames]
    whole = 192 + sum(sizes)
    toc = bytes(min(255, (192 + sum(sizes[: i * len(sizes) // 100])) * 256 // whole) for i in range(100))
    table = (bytes([0xFF, 0xFB, 0x54, 0xC0]) + bytes(17) + b"Xing\0\0\0\7" + len(frames).to_bytes(4, "big") + whole.to_bytes(4, "big") + toc).ljust(192, b"\0")
    first = len(tag) + 192
    n = len(frames)
    feature = f"mpeg1 layer3 ch=1 rate=48000 frames={n} samples={1152 * n} crc={n}/0 skipped=0 vbr=Xing:{n}:{whole} seek={first}-{first + sum(sizes[:-1])}"
    return tag + table + b"".join(frames), feature


def test_op6(spark, sf_dir, docs):
    out = run(spark, sf_dir, "op6_mpeg_audio")
    for i, text, _ in docs:
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (out[i]["n_bytes"], out[i]["payload_bytes"], out[i]["payload_sha256"], out[i]["tail_crc32"]) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        media, feature = plain_media(payload)
        assert (out[i]["media_bytes"], out[i]["media_sha256"], out[i]["feature"]) == (len(media), sha(media), feature)


def test_op7(spark, sf_dir, docs):
    import base64

    import tiktoken

    with open(tokenizers_files.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    enc = tiktoken.Encoding("plain", pat_str=tokenizers_files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = run(spark, sf_dir, "op7_byte_bpe")
    for i, text, _ in docs:
        ids = enc.encode_ordinary(text or "")
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))


def test_op8(spark, sf_dir, docs):
    out, order = run(spark, sf_dir, "op8_minhash"), docs[::-1]

    def shingles(text):
        w = text.encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    errors = []
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i]["n_chars"] == len(text) and out[i]["edited_sha256"] == sha(edited.encode())
        a, b = shingles(text), shingles(edited)
        if len(a) > 50:
            errors.append(out[i]["near_edited"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_op9(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers_files.path("word_bpe_49k.json"))
    out = run(spark, sf_dir, "op9_token_counts")
    for i, text, _ in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((text or "").encode()), n, n > 2048)


def test_op10(spark, sf_dir, docs):
    out, prints = run(spark, sf_dir, "op10_simhash"), {i: plain_simhash(text) for i, text, _ in docs}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3]
    want = components(list(prints), links)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
