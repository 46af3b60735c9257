import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, table, words
from tidemark.llm.quality import NAMES, fit, held_out, with_features, with_scores


def labelled(seed=5, n=300):
    rng = random.Random(seed)
    return [(i, words(rng, rng.randint(20, 80)) if i % 3 else " | ".join(words(rng, 2) + "###" for _ in range(20)), int(i % 3 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = spark.createDataFrame(labelled(), "doc_id long, text string, label int")
    data = with_features(rows, keep_text=False).withColumn("held_out", held_out())
    model = fit(data.filter("NOT held_out"))
    out = with_scores(data, model).collect()
    assert all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert held and np.mean([(r["score"] >= 0.7) == bool(r["label"]) for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_fit_is_the_plain_discriminant(spark):
    rows = spark.createDataFrame(labelled(), "doc_id long, text string, label int")
    data = with_features(rows, keep_text=False)
    model = fit(data, pool=0.3, diagonal=0.1)
    local = data.toPandas()
    x, y = np.array(local["features"].tolist()), local["label"].to_numpy()
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).sum() for k, c in enumerate(covs)) / len(y)
    logs = []
    for k, c in enumerate(covs):
        c = 0.7 * c + 0.3 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-4 * np.eye(len(c))
        d = x - x[y == k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.gap(x), logs[1] - logs[0], rtol=1e-5, atol=1e-5)


def test_hard_rows(spark):
    docs = table(spark, documents()).withColumn("features", F.lit("old"))
    made = with_features(docs)
    rows = made.collect()
    assert len(rows) == 60 and all(len(r["features"]) == len(NAMES) and np.isfinite(r["features"]).all() for r in rows)
    one_class = fit(made.select("features", F.lit(1).alias("label")))
    scores = [r["score"] for r in with_scores(made, one_class).collect()]
    assert len(scores) == 60 and len(set(scores)) == 1 and scores[0] > 0.9
    nothing = fit(made.select("features", F.lit(None).cast("int").alias("label")))
    assert nothing.score(np.zeros((1, len(NAMES))))[0] == 0.5
    assert with_features(table(spark, [])).count() == 0
