"""SimHash near-duplicates through a segment-popcount embedding.

``fingerprints`` adds the 64-bit SimHash of word shingles. ``links`` finds all pairs of different fingerprints within ``radius``
bits: a fingerprint is mapped to the bit counts of its 32 two-bit segments, packed two bits each into a long. The Manhattan
distance of two such vectors is never more than the fingerprints' Hamming distance. The segments are cut into ``parts``; vectors within a
Manhattan distance of 3 differ in at most 3 of them, so they are equal in the others: each choice of all but ``radius`` parts is a grid whose
cells are the vectors on these parts, and such a pair shares a cell of one grid at least. The candidates of this range join are held
against the whole embedding's distance, then against the exact Hamming distance. More parts make more grids of finer cells; all choices give the
same pairs, and ``parts_for`` takes the one of least work for the number of fingerprints. No cell is capped: all its rows
are equal keys of one join, whose hot keys Spark may split; equal fingerprints are one row.

``clusters`` gives each document the least doc_id that it can reach over links; copies share a fingerprint and so need no link.

Nulls and texts without a word have fingerprint zero and are linked like any other. Texts with fewer words than a shingle have
one shingle, all their words. Repeated rows stay (each gets the same result); an empty table gives an empty one. Other columns
are kept, those named like an output are replaced. A null doc_id takes part in links but is never a component's name unless
all members' ids are null, where the component is null.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, slices
from tidemark.llm.components import components

#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as a signed long: a bit is set if it is in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    total, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(at, min(n, at + AT_ONCE))], np.uint64)
        total += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, size: int = 3, seed: int = 42, text: str = "text", out: str = "fp", keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``: long. ``keep_text`` False drops the text on the way."""
    rest = [c for c in df.columns if c != out and (keep_text or c != text)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.LongType(), False)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array([fingerprint(x, size, seed) for x in part.column(text).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, out])

    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, text]))).mapInArrow(run, schema)


#: The low bit of each two-bit segment.
_LOW = 0x5555555555555555


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits each."""
    a, b = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed vectors of counts 0 to 2. With counts in unary (0, 1, 3) it is a Hamming distance."""

    def unary(v: Column) -> Column:
        return v.bitwiseOR(F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(_LOW)))

    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def parts_for(n: int, radius: int = 3) -> int:
    """Parts of least work: rows of the grids and expected candidates of ``n`` random fingerprints, whose segments' counts agree in 3 of 8 cases each."""
    return min(range(radius + 2, 17), key=lambda p: comb(p, radius) * (1 + n / 2 * 0.375 ** (32 - radius * -(-32 // p))))


def links(prints: DataFrame, radius: int = 3, parts: int | None = None) -> DataFrame:
    """``prints``: one column fp (long, distinct) to (a, b), a < b: all pairs within ``radius`` bits."""
    if radius < 0:
        raise ValueError("a radius is 0 or more")
    parts = parts or parts_for(prints.count(), radius)
    cuts = [32 * i // parts for i in range(parts + 1)]
    masks = [sum((1 << 2 * b) - (1 << 2 * a) for a, b in chosen) for chosen in combinations(list(zip(cuts, cuts[1:], strict=False)), parts - radius)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    # a cell's grid and counts as one hash: two cells of one hash only make more candidates
    cells = F.transform(signed, lambda m, i: F.xxhash64(i, F.col("v").bitwiseAND(m)))
    placed = prints.select("fp", embedding(F.col("fp")).alias("v")).select("fp", F.explode(cells).alias("cell"))
    found = placed.withColumnRenamed("fp", "a").join(placed.withColumnRenamed("fp", "b"), "cell").filter("a < b")
    found = found.filter(manhattan(embedding(F.col("a")), embedding(F.col("b"))) <= radius)
    return found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def clusters(prints: DataFrame, radius: int = 3, doc_id: str = "doc_id") -> DataFrame:
    """Rows with ``doc_id`` and fp, to the same with component_id."""
    groups = materialise(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "prints")
    of = components(links(groups.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    named = materialise(groups.join(of, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    best = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(best, "component").select("fp", "component_id")
    return prints.drop("component_id").join(ids, "fp")
