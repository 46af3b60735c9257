"""A training-data pipeline: quality classifier, SimHash near-dedup, suffix-array dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. ``run`` applies them to ``documents``, each stage's result
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_texts
from tidemark.llm.common import bound_batches, bounded_batches, discard, materialise, temporary
from tidemark.llm.mixing import mix, word_count
from tidemark.llm.near import one_of_each
from tidemark.llm.quality import few_labels, fit, held_out, with_features, with_scores
from tidemark.llm.suffix_dedup import dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score less go.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quadratic discriminant scores below ``LEAST_QUALITY``; it learns from the labelled ones that aren't held out (a million of them, by a hash of the id, if there are more)."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    known = with_features(docs.select("doc_id", "text").join(F.broadcast(few_labels(labels)), "doc_id"), keep_text=False)
    model = fit(materialise(known, "features"))
    scored = with_scores(with_features(docs.select(*COLUMNS), out="quality_features"), model, features="quality_features", out="quality_score")
    return scored.filter(F.col("quality_score") >= LEAST_QUALITY).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five-word shingles alike by 0.8, or 64-bit SimHashes within three bits), that of the least doc_id. Different texts under one doc_id are documents of their own."""
    bound_batches(spark)
    return one_of_each(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeats of 100 bytes and more out of the texts. Bytes of a character of which a part went go too."""
    bound_batches(spark)
    left = dedup(docs.select(*COLUMNS))
    text = _text("kept")
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _text(column: str):
    """Whole characters of a binary column."""

    @F.pandas_udf("string")
    def whole(x):
        return x.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return whole(column)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources share 150 % of all words by the weights 3, 1, 2, up to twice each source's own."""
    bound_batches(spark)
    sized = docs.select(*COLUMNS).withColumn("words", word_count())
    return _copied(mix(sized, [3.0, 1.0, 2.0], 1.5, 2.0, size="words"))


def _copied(mixed: DataFrame) -> DataFrame:
    """A row for each copy."""
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text, with whether they decode to its bytes."""
    bound_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode_texts(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, round_trip="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("encoding", encoding)]

#: A trained model's scores and random rounding can't be written as SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's scratch tables are deleted once its result is written, and that result once the next one is; the session's settings are restored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    with bounded_batches(spark):
        for name, stage in STAGES:
            with temporary(spark):
                docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
            if before is not None:
                discard(before)
            before = docs
    return docs
