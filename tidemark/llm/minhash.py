"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit packing.

Each shingle (five words, or all words of a shorter text) is hashed once: the top bits of the hash choose one of ``bins`` bins,
the rest is a value, and a bin keeps its least value. An empty bin takes the value of a bin that a fixed sequence of hashes of
its own number and the attempt points to, the first that isn't empty; so two texts borrow alike. Of each value the low ``bits``
bits are stored, packed, as lowercase hex. Two unlike values agree in these with probability 2**-bits, which ``likeness``
removes: (agreeing - 2**-bits) / (1 - 2**-bits), not below 0.

Words are runs of bytes that aren't ASCII white space, of the text as it is. A text without words has the empty fingerprint:
like another such one by 1, any other by 0. Null texts are empty ones. Any length goes; repeated rows get equal fingerprints; an
empty table gives an empty one; other columns are kept, those named like an output are replaced.

``with_next`` also needs each document's follower. Rows are dealt to ranges of (doc_id from high to low, null last; hash of the text; place) by
Spark's range exchange and sorted within, so that one id with very many rows, or none, is many ranges too. One pass over a range sees every pair in
it. Only a range's last row and first row are open; they are written, and joined with those of the neighbouring ranges in a second pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ByteHasher, materialise, mix64, shingle_hashes, slices, text_buffer, word_spans

BINS, BITS, SHINGLE = 256, 8, 5
#: Bytes of text in a range of ids.
RANGE_BYTES = 32 << 20


class Fingerprinter:
    """Fingerprints of rows of texts; ``bits`` is 1, 2, 4 or 8 and ``bins`` a power of two from 8 on."""

    def __init__(self, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> None:
        if bins & (bins - 1) or bins < 8 or bits not in (1, 2, 4, 8):
            raise ValueError("bins: a power of two from 8 on; bits: 1, 2, 4 or 8")
        self.bins, self.bits, self.size, self._hasher = bins, bits, size, ByteHasher()

    def bins_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Low bits of each row's bins (rows x bins), and which rows have words."""
        n, k = len(offsets) - 1, self.bins
        starts, ends, rows = word_spans(data, offsets)
        hashes, at = shingle_hashes(self._hasher.spans(data, starts, ends), rows, n, self.size)
        shift = np.uint64(64 - (k - 1).bit_length())
        most = np.uint64(2**64 - 1)
        least = np.full(n * k, most, np.uint64)
        np.minimum.at(least, at * k + (hashes >> shift).astype(np.int64), hashes & np.uint64((1 << int(shift)) - 1))
        least = least.reshape(n, k)
        full = least != most
        some = full.any(1)
        row, hole = np.nonzero(~full & some[:, None])
        attempt = 0
        while len(row):
            attempt += 1
            seed = np.uint64(attempt * 0x9E3779B97F4A7C15 % 2**64)
            aim = (mix64(hole.astype(np.uint64) + seed) >> shift).astype(np.int64)
            hit = full[row, aim]
            least[row[hit], hole[hit]] = least[row[hit], aim[hit]]
            row, hole = row[~hit], hole[~hit]
        return (least & np.uint64((1 << self.bits) - 1)).astype(np.uint8), some

    def packed(self, low: np.ndarray, some: np.ndarray) -> list[bytes]:
        """The bins of each row; empty for one without words."""
        per = 8 // self.bits
        joined = low.reshape(len(low), -1, per)
        out = np.zeros(joined.shape[:2], np.uint8)
        for j in range(per):
            out |= joined[:, :, j] << np.uint8(j * self.bits)
        return [x.tobytes() if y else b"" for x, y in zip(out, some.tolist(), strict=True)]

    def likeness(self, a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
        """Bias-corrected estimates of the Jaccard similarity, row by row."""
        chance = 2.0**-self.bits
        out = np.maximum(((a == b).mean(1) - chance) / (1 - chance), 0.0)
        return np.where(some_a & some_b, out, np.where(some_a | some_b, 0.0, 1.0))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> DataFrame:
    """``df`` with ``out``: string."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType(), False)])

    def run(batches):
        make = Fingerprinter(bins, bits, size)
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array([x.hex() for x in make.packed(*make.bins_of(*text_buffer(part.column(text))))], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, out])

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


#: As made in tasks; what is binary here becomes hex at the end, so that it is written in half the bytes.
_MADE = "n_chars long, edited_text string, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def with_next(df: DataFrame, keep_text: bool = False, range_bytes: int = RANGE_BYTES, bins: int = BINS, bits: int = BITS, size: int = SHINGLE) -> DataFrame:
    """``df`` (doc_id, text and others) with each document held against an edited copy of itself and against the next document in descending doc_id.

    The edited text has its last floor(n/2) characters replaced by as many of the next document's first ones (or all); after the
    last document comes the first. Null ids come last; rows of one id are in the order of a hash of their text. All columns are kept but
    those named like an output; text and edited_text (else null) only with ``keep_text``.
    """
    made = T.StructType.fromDDL(_MADE)
    rest = [c for c in df.columns if c not in made.names and (keep_text or c != "text")]
    names = {c: f"_c{i}" for i, c in enumerate(rest)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // range_bytes))
    order = [F.col("doc_id").desc_nulls_last(), "tie", "place"]
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie", "place", "doc_id")
    kept = T.StructType([rows.schema[n] for n in names.values()])
    # kind 0: a finished row; 1: the range's last row, whose follower is in another range; 2: the range's first row
    schema = T.StructType([*kept, *made, T.StructField("text", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType())])
    first = materialise(rows.mapInArrow(_in_range(kept.names, keep_text, bins, bits, size), schema), "ranges")
    # the next range that has rows; the last one's is the first
    ends = first.filter("kind = 2").select("part", F.col("text").alias("next_text"))
    ring = first.filter("kind = 2").groupBy("part").count().select("part")
    ring = ring.withColumn("after", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    open_rows = first.filter("kind = 1").select(*kept.names, "text", "part").join(ring, "part").join(ends.withColumnRenamed("part", "after"), "after")
    last = open_rows.select(*kept.names, "text", "next_text").mapInArrow(_across(kept.names, keep_text, bins, bits, size), T.StructType([*kept, *made]))
    out = first.filter("kind = 0").select(*kept.names, *made.names).unionByName(last)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.lower(F.hex(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else f.name for f in made])


def _held(make: Fingerprinter, texts: list[str], after: list[str], low: np.ndarray, some: np.ndarray, low_next: np.ndarray, some_next: np.ndarray, keep_text: bool) -> list[pa.Array]:
    """The columns of ``_MADE`` for texts and their followers."""
    edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, after, strict=True)]
    low_e, some_e = make.bins_of(*text_buffer(pa.array(edited, pa.large_string())))
    return [
        pa.array([len(x) for x in texts], pa.int64()), pa.array(edited if keep_text else [None] * len(edited), pa.string()), pa.array([hashlib.sha256(x.encode()).digest() for x in edited], pa.binary()),
        pa.array(make.packed(low, some), pa.binary()), pa.array(make.packed(low_e, some_e), pa.binary()), pa.array(make.likeness(low, some, low_e, some_e)), pa.array(make.likeness(low, some, low_next, some_next)),
    ]


def _in_range(rest: list[str], keep_text: bool, bins: int, bits: int, size: int):
    """A sorted range's rows: all but the last are finished; the last and a copy of the first are handed on."""
    made = [f.name for f in T.StructType.fromDDL(_MADE)]

    def handed(row: pa.RecordBatch, text: str, kind: int, part: int) -> pa.RecordBatch:
        empty = [pa.nulls(1, kind) for kind in _KINDS]
        return pa.RecordBatch.from_arrays([*(row.column(c) for c in rest), *empty, pa.array([text], pa.string()), pa.array([kind], pa.int32()), pa.array([part], pa.int32())], [*rest, *made, "text", "kind", "part"])

    def run(batches):
        make, last, part = Fingerprinter(bins, bits, size), None, TaskContext.get().partitionId()
        for batch in batches:
            for chunk in slices(batch, "text", 1 << 20):
                texts = chunk.column("text").to_pylist()
                low, some = make.bins_of(*text_buffer(chunk.column("text")))
                if last is None:
                    yield handed(chunk.slice(0, 1), texts[0], 2, part)
                else:
                    chunk = pa.Table.from_batches([last[0], chunk]).combine_chunks().to_batches()[0]
                    texts, low, some = [last[1], *texts], np.concatenate([last[2], low]), np.concatenate([last[3], some])
                n = len(texts) - 1
                if n:
                    columns = _held(make, texts[:-1], texts[1:], low[:-1], some[:-1], low[1:], some[1:], keep_text)
                    yield pa.RecordBatch.from_arrays([*(chunk.column(c).slice(0, n) for c in rest), *columns, pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32())], [*rest, *made, "text", "kind", "part"])
                last = (chunk.slice(n, 1), texts[-1], low[-1:], some[-1:])
        if last is not None:
            yield handed(last[0], last[1], 1, part)

    return run


def _across(rest: list[str], keep_text: bool, bins: int, bits: int, size: int):
    """The ranges' last rows with their followers' texts."""
    made = [f.name for f in T.StructType.fromDDL(_MADE)]

    def run(batches):
        make = Fingerprinter(bins, bits, size)
        for batch in batches:
            for chunk in slices(batch, "text", 1 << 20):
                texts, after = chunk.column("text").to_pylist(), chunk.column("next_text").to_pylist()
                own, other = make.bins_of(*text_buffer(chunk.column("text"))), make.bins_of(*text_buffer(chunk.column("next_text")))
                yield pa.RecordBatch.from_arrays([*(chunk.column(c) for c in rest), *_held(make, texts, after, *own, *other, keep_text)], [*rest, *made])

    return run
