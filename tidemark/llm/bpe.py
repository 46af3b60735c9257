"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode_texts`` adds the ids of every text, ``decode_ids`` turns ids back into raw bytes. Ids are what the library's
``encode_ordinary`` gives: each match of the pattern is merged on its own and strings of special tokens are ordinary text.

Long texts are cut where no match of the pattern can cross: between a character that isn't white space and a blank. Every
match is white space only, or at most one blank and then characters that aren't; so none goes on after such a place, and none
looks back. White space in the middle of a long run is one match but for its last character; the library's
pattern engine backtracks over the run, so runs beyond ``LONG_RUN`` are cut before their last character and their ids come
from the merges alone.

Null texts are encoded as empty ones (no ids). Empty tables give empty tables. Repeated rows are encoded alike. Other columns
are kept; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

#: Characters from which a text is cut, and of a run of white space from which it is set apart.
LONG_TEXT, LONG_RUN = 1 << 16, 1 << 12
#: White space as the pattern's engine knows it, as explicit ranges.
_WHITE = r"\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


@lru_cache(2)
def encoding(rank_file: str, pattern: str):
    """The library's encoding for a local rank file: one per process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(f"local:{rank_file}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cuts a text so that the encodings of its pieces, joined, are its own."""
    at, n = 0, len(text)
    while n - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode(enc, text: str) -> list[int]:
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in _RUN.finditer(text):
        # all but the last character of a run that something follows is one match, or all of a run at the end
        start, end = run.start(), run.end() - (run.end() < len(text))
        for piece in safe_pieces(text[at:start]):
            ids += enc.encode_ordinary(piece)
        ids += enc._encode_single_piece(text[start:end])
        at = end
    for piece in safe_pieces(text[at:]):
        ids += enc.encode_ordinary(piece)
    return ids


def encode_texts(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "token_ids", round_trip: str | None = None) -> DataFrame:
    """``df`` with the column ``out``: array<int>, the ids of the whole text. ``rank_file`` is a path that every executor has. ``round_trip`` names a boolean column: whether the ids decode to the text's bytes."""
    rest = [c for c in df.columns if c not in (out, round_trip)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    if round_trip:
        schema = schema.add(round_trip, T.BooleanType(), False)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                ids = [encode(enc, x) if x else [] for x in texts]
                made = [pa.array(ids, pa.list_(pa.int32()))]
                if round_trip:
                    made.append(pa.array([enc.decode_bytes(i) == (x or "").encode() for i, x in zip(ids, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made], schema.names)

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``: binary, the bytes of the ids joined; not text, as ids can end within a character. Null ids give empty bytes."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array([enc.decode_bytes(x) if x else b"" for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, out])

    return df.mapInArrow(run, schema)
