"""The queries opN of the text operators: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, materialise, narrow_reads, temporary


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _written(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its rows written under small Arrow batches, its scratch tables deleted and the session's settings restored."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with bounded_batches(spark), temporary(spark):
            return materialise(query(spark, sf_dir), query.__name__, keep=True)

    return run


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shuffle_into_shards

    docs = _documents(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"))
    return shuffle_into_shards(rows, 16, seed=11).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix, word_count

    docs = _documents(spark, sf_dir).select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("text_hash"))
    return mix(docs, [3.0, 1.0, 2.0], 1.5, 2.0).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import dedup

    found = dedup(_documents(spark, sf_dir).select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import fit, held_out, with_features, with_scores

    with narrow_reads(spark):
        rows = materialise(with_features(_documents(spark, sf_dir).select("doc_id", "text"), keep_text=False), "features")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.join(labels, "doc_id").select("features", "label"))
    scored = with_scores(rows.select("doc_id", held_out().alias("held_out"), "features"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licences import scan

    found = scan(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("licences", ";").alias("licences"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mpeg import parse_media, store_texts

    docs = _documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    rows = parse_media(store_texts(docs, keep_text=False))
    a = F.col("audio")
    feature = F.format_string(
        "mpeg%s layer%d ch=%d rate=%d frames=%d samples=%d crc=%d/%d skipped=%d vbr=%s:%d:%d seek=%d-%d", a["version"], a["layer"], a["channels"], a["sample_rate"], a["frames"], a["samples"], a["crc_good"], a["crc_bad"], a["skipped_bytes"],
        a["vbr_kind"], a["vbr_frames"], a["vbr_bytes"], F.element_at(a["frame_offsets"], 1), F.element_at(a["frame_offsets"], -1),
    )
    payload = a["payload"]
    return rows.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), (a["samples"] / a["sample_rate"]).alias("seconds"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import decode_ids, encode_texts

    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    ids = encode_texts(_documents(spark, sf_dir).select("doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text")
    back = decode_ids(ids, ranks, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.minhash import with_next

    with bounded_batches(spark):  # the pass over the texts is written within; what is left are the ranges' ends
        found = with_next(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.counts import count_tokens

    docs = _documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, _tokenizer("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import clusters, fingerprints

    prints = materialise(fingerprints(_documents(spark, sf_dir).select("doc_id", "text"), keep_text=False), "simhash")
    return clusters(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_trie_of(conversations: DataFrame, **bounds) -> DataFrame:
    from tidemark.llm.trie import light_turns, rebuilt, trie

    turns = materialise(light_turns(conversations), "turns")
    return trie(rebuilt(turns), materialise(turns.groupBy("conv_id").agg(F.count("*").alias("turns")).select("conv_id"), "ids"), **bounds)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_trie_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_repair_of(conversations: DataFrame) -> DataFrame:
    from tidemark.llm.repair import damaged, repair

    return repair(damaged(conversations))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_repair_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import scan

    return scan(_documents(spark, sf_dir).select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline, "op5_licences": op5_licences, "op8_minhash": op8_minhash} | {f.__name__: _written(f) for f in (op1_shards, op2_mix, op3_suffix_dedup, op4_quality, op6_mpeg_audio, op7_byte_bpe, op9_token_counts, op10_simhash, op11_prefix_trie, op12_repair, op13_pii)}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm.licences import scan_sql

    return {"op5_licences": scan_sql()}
