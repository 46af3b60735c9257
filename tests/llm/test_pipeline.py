import random

import corpus_pipeline
from tests.llm.helpers import SCHEMA, components, words
from tests.llm.test_near import plain_simhash
from tests.llm.test_suffix_dedup import plain


def corpus(spark, path):
    rng = random.Random(11)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(30, 90)) for _ in range(120)]
    for i in range(0, 120, 6):
        texts[i] = " ".join(words(rng, 1) + "$$$" for _ in range(40))
    for i in range(3, 120, 10):
        texts[i] = texts[i][:100] + " " + passage + " " + texts[i][100:]
    texts[49], texts[51] = texts[41], texts[41] + " "
    long = words(rng, 150).split()
    texts[70], texts[71] = " ".join(long), " ".join([*long[:60], "changed", *long[61:]])
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_every_stage(spark, tmp_path):
    path = str(tmp_path)
    rows = corpus(spark, path)
    by = {name: f for name, f in corpus_pipeline.STAGES}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    good = by["quality"](spark, docs, path)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    junk = {i for i in range(0, 120, 6)}
    assert not kept & junk and len(kept) >= 97
    one = by["near_dedup"](spark, good, path)
    prints = {i: plain_simhash(rows[i][1]) for i in kept}
    shingles = {i: set(zip(*(rows[i][1].lower().split()[k:] for k in range(5)), strict=False)) for i in kept}
    alike = [(i, j) for i in kept for j in kept if i < j and (bin(prints[i] ^ prints[j]).count("1") <= 3 or len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]))]
    want = {i for i, c in components(kept, alike).items() if i == c}
    assert 51 not in want and 71 not in want
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns
    cut = {r["doc_id"]: r for r in by["suffix_dedup"](spark, one, path).collect()}
    left = plain([rows[i] for i in want], 100)
    assert {i: r["text"].encode() for i, r in cut.items()} == {i: x[0] for i, x in left.items()}
    assert any(x[2] for x in left.values()) and all(r["n_chars"] == len(r["text"]) for r in cut.values())


def test_run(spark, tmp_path):
    path = str(tmp_path)
    corpus(spark, path)
    out = corpus_pipeline.run(spark, path).collect()
    assert out and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in out)
    again = corpus_pipeline.run(spark, path).collect()
    assert sorted(r["doc_id"] for r in again) == sorted(r["doc_id"] for r in out)


def test_no_documents(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_documents_without_ids_or_texts(spark):
    near = dict(corpus_pipeline.STAGES)["near_dedup"]
    # two texts under one id, and rows that differ in other columns only
    twice = [(7, "this text has an id that is another one's too", "en", "a", 1), (7, "and so has this, which has nothing else in common with it", "en", "a", 1), (7, "and so has this, which has nothing else in common with it", "de", "b", 2)]
    kept = near(spark, spark.createDataFrame(twice, SCHEMA), "").collect()
    assert sorted(map(tuple, kept)) == sorted([twice[0], twice[2]])
    rows = [(None, "first text of many words here", None, None, None), (None, "another one that is not like it", None, None, None), (None, "another one that is not like it", "x", None, 1), (3, None, None, None, None), (4, "", None, None, None), (5, "another one that is not like it", None, None, None)]
    out = near(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out) == [(-1, "first text of many words here"), (3, ""), (5, "another one that is not like it")]
