"""Near-duplicate groups of documents at a similarity of 0.8 of their five-word shingles.

Candidates come from the shingles themselves: a text's 512-bin one-permutation MinHash gives 64 bands of 8 bins, each hashed with its number into one long, a
cell. A bin agrees with a chance of the similarity, wherever the texts differ (words here and there, a passage added or cut off), so two texts
alike by 0.8 share no cell in 8 cases of a million, and by more in fewer; texts alike by 0.3 share one in 4 cases of a thousand, others by chance only (2**-64 a cell).

First each text of a cell is held against the one of its texts that meets most others in all its cells (the centre of a group of near copies, if there is one),
and components are taken of those that are alike. That is one pair for each place in a cell, however crowded it is. Then all texts of cells that still
have several components are joined by an exact prefix filter: of two sets alike by 0.8, in any one order of all shingles, the first shingle that they share stands within
the first fifth of the larger set (and ninth of the smaller), with enough left after it in both. The order is by rarity among these texts, so
that what stands first is mostly a text's own, and few pairs of different components are candidates; none that is alike is lost.

A candidate whose fingerprints' bias-corrected likeness reaches ``SKETCH`` (standard error 0.018, so over five of them below) is decided by the exact Jaccard
similarity of the two texts' shingles (64-bit hashes), 0.8 or more. Links of 64-bit SimHashes within three bits (``simhash.links``, the popcount grids), which
find texts that differ in a word or two of hundreds, are added, then components are taken.

The nodes are the different texts, not the ids: ``representatives`` gives each text a number of its own, so that two texts under one id, or
without one, are two nodes, and copies are one. Words are lower-cased for A-Z. Texts without a word (null, empty, white space) are one group through their
64-bit print. Repeated rows and long texts are no special cases; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ByteHasher, materialise, mix64, shingle_hashes, slices, temporary, text_buffer, word_spans
from tidemark.llm.components import components
from tidemark.llm.minhash import Fingerprinter
from tidemark.llm.simhash import fingerprint, links

BANDS, ROWS, BINS, SIZE = 64, 8, 512, 5
SKETCH = 0.7


def representatives(docs: DataFrame) -> DataFrame:
    """A row for each different text (null is empty): that of the least doc_id, null last, then of the least other columns, with ``copy`` (the text's SHA-256) and a number ``node``. To be written before use, as numbers follow the partitions."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    copy = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", *rest, "text")
    least = docs.select(copy.alias("copy"), row.alias("row")).groupBy("copy").agg(F.min("row").alias("row"))
    return least.select(F.monotonically_increasing_id().alias("node"), "copy", *[F.col(f"row.{c}") for c in docs.columns])


def cells_of(low: np.ndarray) -> np.ndarray:
    """The cells of fingerprints (rows x bins, a byte each): hashes of a band's bins and its number."""
    bands = np.ascontiguousarray(low[:, : BANDS * ROWS]).view("<u8").reshape(len(low), BANDS)
    return mix64(mix64(bands) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def prints(texts: DataFrame) -> DataFrame:
    """node and text to node, fp, cells, sketch (64 longs) and has_words."""
    schema = "node long, fp long, cells array<long>, sketch array<long>, has_words boolean"

    def run(batches):
        make = Fingerprinter(BINS, 8, SIZE)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text")
                data, offsets = text_buffer(texts)
                data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
                low, some = make.bins_of(data, offsets)
                columns = [part.column("node"), pa.array([fingerprint(x) for x in texts.to_pylist()], pa.int64()), pa.array(list(cells_of(low)), pa.list_(pa.int64())), pa.array(list(low.view(np.int64)), pa.list_(pa.int64())), pa.array(some)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "fp", "cells", "sketch", "has_words"])

    return texts.select("node", "text").mapInArrow(run, schema)


def _alike(a: Column, b: Column) -> Column:
    """Bias-corrected share of equal bytes."""

    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(int.from_bytes(bytes([mask]) * 8)))
        return F.bit_count(d)

    agree = 1 - F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda t, x: t + x) / F.lit(float(BINS))
    return (agree - 1 / 256) / (1 - 1 / 256)


def _shingles(texts: DataFrame) -> DataFrame:
    """node and text to node and the different shingles' hashes."""

    def run(batches):
        hasher = ByteHasher()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = text_buffer(part.column("text"))
                data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
                starts, ends, rows = word_spans(data, offsets)
                hashes, at = shingle_hashes(hasher.spans(data, starts, ends), rows, part.num_rows, SIZE)
                order = np.lexsort((hashes, at))
                hashes, at = hashes[order], at[order]
                first = np.ones(len(at), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1])
                cuts = np.searchsorted(at[first], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(hashes[first].view(np.int64)))], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _held(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: nodes) that are alike."""

    def both(of: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(of.select(F.col("node").alias(x), F.col(column).alias(f"s{x}")), x)
        return pairs

    def wanted(of: DataFrame, pairs: DataFrame) -> DataFrame:
        return of.join(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "node", "left_semi")

    pairs = materialise(pairs, "pairs")
    sketch = materialise(wanted(nodes.select("node", "sketch"), pairs), "sketches")
    close = materialise(both(sketch, pairs, "sketch").filter(_alike(F.col("sa"), F.col("sb")) >= SKETCH).select("a", "b").distinct(), "close")
    held = both(materialise(_shingles(wanted(texts.select("node", "text"), close)), "shingles"), close, "shingles")
    # 0.8 of the union, in whole numbers
    return materialise(held.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "held")


def _alike_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all alike pairs that share a cell."""
    placed = nodes.filter("has_words").select("node", F.explode("cells").alias("cell"))
    crowded = materialise(placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "crowded")
    shared = materialise(placed.join(crowded, "cell"), "shared")
    meets = materialise(shared.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    heads = materialise(shared.join(meets, "node").groupBy("cell").agg(F.max(F.struct("meets", "node"))["node"].alias("head")), "heads")
    stars = shared.join(heads, "cell").filter("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    first = _held(stars, nodes, texts)
    named = shared.select("cell", "node").join(materialise(components(first), "components"), "node", "left").select("cell", "node", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "named")
    several = materialise(named.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("cell"), "several")
    open_nodes = materialise(named.join(several, "cell").select("node", "component").distinct(), "open")
    return first.unionByName(_held(_prefix_pairs(open_nodes, texts), nodes, texts))


def _prefix_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``nodes`` (node, component), all pairs (a, b) of different components that can be alike by 0.8, and few others."""
    sets = materialise(_shingles(texts.select("node", "text").join(nodes, "node", "left_semi")), "sets")
    rows = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = materialise(rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    both = rows.join(often, "shingle")
    # a set's own shingles stand first, then the others by rarity
    order, whole = Window.partitionBy("node").orderBy("n", "shingle"), Window.partitionBy("node")
    both = both.withColumn("place", F.col("size") - F.count("*").over(whole) + F.row_number().over(order) - 1)
    early = materialise(both.filter("5 * place <= size").select("node", "shingle", "size", "place").join(nodes, "node"), "early")
    large, small = (early.toDF(f"n{x}", "shingle", f"s{x}", f"p{x}", f"c{x}") for x in "ab")
    small = small.filter("9 * pb <= sb")
    met = (F.col("ca") != F.col("cb")) & ((F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("na") > F.col("nb")))) & (5 * F.col("sb") >= 4 * F.col("sa"))
    # what is left from the shared shingle on can make 0.8 of the union
    met = met & (9 * F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) >= 4 * (F.col("sa") + F.col("sb")))
    return large.join(small, (large["shingle"] == small["shingle"]) & met).select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()


def groups(texts: DataFrame) -> DataFrame:
    """node and text (a written table of different texts) to (node, component): the least node of its group."""
    with temporary(texts.sparkSession):
        nodes = materialise(prints(texts), "prints")
        held = _alike_links(nodes, texts)
        # those of the 64-bit prints
        first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
        equal = nodes.join(first, "fp").select(F.col("head").alias("a"), F.col("node").alias("b")).filter("a <> b")
        named = first.select("fp", F.col("head").cast("long"))
        tight = links(first.select("fp")).join(named.toDF("a", "ha"), "a").join(named.toDF("b", "hb"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
        joined = components(held.unionByName(equal).unionByName(tight))
        return materialise(nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "groups", keep=True)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicate rows of ``docs`` (doc_id, text and others) the one of the least doc_id (null last; of texts under one id, the one of the least SHA-256)."""
    texts = materialise(representatives(docs), "texts")
    found = groups(texts)
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "copy", "node")
    best = texts.select("node", row.alias("row")).join(found, "node").groupBy("component").agg(F.min("row").alias("row"))
    return texts.join(best.select("row.node"), "node", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def named_groups(docs: DataFrame) -> DataFrame:
    """doc_id and text to (doc_id, copy, component) for each different pair of id and text: ``component`` is the least doc_id of its group, null where none has one."""
    texts = materialise(representatives(docs.select("doc_id", "text")), "texts")
    found = groups(texts).join(texts.select("node", "copy"), "node")
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("copy")).distinct()
    rows = materialise(rows.join(found, "copy").select("doc_id", "copy", F.col("component").alias("group")), "named")
    least = materialise(rows.groupBy("group").agg(F.min("doc_id").alias("component")), "least")
    return rows.join(least, "group").select("doc_id", "copy", "component")
