"""Exact removal of long repeated byte strings through merged Burrows-Wheeler transforms.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier: in a document of smaller doc_id, or earlier in the
same one. Texts are whole UTF-8 bytes (null: empty), strings never cross documents, and are judged on the input.

How it is cut into tasks without losing a match. The anchor of a string of ``LENGTH`` bytes is its ``GRAM``-byte piece of the least
hash (the first of equal ones): the string alone decides it, so equal strings have equal anchors at equal places. The strings of a text with the
same anchor follow each other; together they are the anchor's context, some 100 to 180 bytes. Documents are dealt into shards.

1. Each partition gives the hashes of its anchors with the shards they are in and their contexts' number. Anchors of one context are dropped: none of
   their strings occurs twice.
2. Each shard sends the contexts of the anchors left to the anchor's task. Contexts that are equal byte by byte are one row, with all its places.
3. A task puts the contexts, each different one once with the number of its places, into shards of suffixes; their Burrows-Wheeler transforms are built and
   merged by interleave refinement, to ``LENGTH`` symbols. The intervals of the merged order that share that many bytes and stand for two places
   or more are the repeated strings; all places but the earliest of each are removed. Nothing is removed that isn't in such an interval;
   hashes only deal rows to tasks and drop what can't repeat.
4. Each shard unites what is removed of its documents and cuts it out.

An anchor with more than ``HOT`` rows (a phrase that very many documents share among different neighbours) would fill one task. Its contexts are
refined first: cut in two by where the anchor stands in the string, each part having a longer piece that all its strings share; these pieces
are their new anchors, those of one place are dropped, and what is still too much is refined again, down to single strings. An anchor that after that
has over ``HOT`` rows (a string in more than so many shards) is judged in two steps, within groups of shards and then among the groups' earliest.

Ties: documents are ordered by doc_id (null last), those with one doc_id by a hash of the text; rows alike in both are the same document and get
the same result. Empty tables give empty ones, texts shorter than ``LENGTH`` bytes nothing to remove. Removed bytes can part a character, so what is kept
is binary. Other columns are kept out; join them by ``doc_id`` or use ``dedup``, which keeps them all. ``doc_id`` is a number; ids of another kind
are for the caller to number first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bwt import repeats, shard_bwt
from tidemark.llm.common import ByteHasher, give_back, materialise, slices, text_buffer

LENGTH, GRAM = 100, 32
#: Bytes of text of a shard; rows of an anchor from which it is refined; bytes merged at once; bytes of a shard of suffixes; shards judged together at first.
SHARD_BYTES, HOT, MERGE_BYTES, SUFFIX_BYTES, SHARD_GROUP = 8 << 20, 50_000, 1 << 18, 1 << 15, 1000
#: Shards up to which the rows of an anchor are counted in a window. Both ways count all of them.
FEW_SHARDS = 1 << 14


class Anchors:
    """Anchors of the strings of rows of texts, as arrays: row, first and last start of the context's strings in the row, hashes of anchor and context, the context's place in the data and the anchor's in the context."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram, self._hasher = length, gram, ByteHasher()

    def find(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        length, gram = self.length, self.gram
        none = np.zeros(0, np.int64)
        if len(data) < length:
            return {"row": none, "first": none, "last": none, "anchor": none, "context": none, "at": none, "gram": none}
        n = len(data) - gram + 1
        places = np.arange(n)
        hashes = self._hasher.spans(data, places, places + gram)
        # the high bits of the hash, then the place: the least is the first of the least
        least = (hashes >> np.uint64(30) << np.uint64(30)) | places.astype(np.uint64)
        span, width = length - gram + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        where = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
        lengths = np.diff(offsets)
        starts = np.zeros(len(where) + 1, np.int32)
        has = lengths >= length
        np.add.at(starts, offsets[:-1][has], 1)
        np.add.at(starts, offsets[1:][has] - length + 1, -1)
        valid = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
        at = where[valid]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        firsts = np.flatnonzero(new)
        first, last = valid[firsts], valid[np.append(firsts[1:], len(at)) - 1]
        row = np.searchsorted(offsets, first, side="right") - 1
        context = self._hasher.spans(data, first, last + length)
        anchor = hashes[at[firsts]]
        return {"row": row, "first": first - offsets[row], "last": last - offsets[row], "anchor": anchor.view(np.int64), "context": context.view(np.int64), "at": first, "gram": at[firsts] - first}


def _anchor_rows(length: int, gram: int):
    """Step 1: (anchor, shard, n, kinds): contexts and different ones."""

    def run(batches):
        make = Anchors(length, gram)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                found = make.find(*text_buffer(part.column("text")))
                if not len(found["row"]):
                    continue
                shard = part.column("shard").to_numpy()[found["row"]]
                order = np.lexsort((found["context"], found["anchor"], shard))
                a, c, s = found["anchor"][order], found["context"][order], shard[order]
                key = np.ones(len(a), bool)
                key[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
                other = key.copy()
                other[1:] |= c[1:] != c[:-1]
                heads = np.flatnonzero(key)
                n = np.diff(np.append(heads, len(a))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a[heads]), pa.array(s[heads], pa.int32()), pa.array(n), pa.array(np.add.reduceat(other.astype(np.int32), heads), pa.int32())], ["anchor", "shard", "n", "kinds"])

    return run


#: Contexts that are sent. ``gram``: where the anchor stands in the body; ``place`` and ``others``: documents of the shard (by number) and offsets, packed.
_SENT = "anchor long, shard int, doc_id long, tie long, first int, gram int, body binary, place long, others array<long>"
_SPAN = "shard int, doc int, first int, last int"


def _documents_of(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The shard's documents in order, one of each; ids with null as the largest."""
    ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    ties = table["tie"].to_numpy()
    order = np.lexsort((ties, ids))
    i, t = ids[order], ties[order]
    keep = np.ones(len(i), bool)
    keep[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
    return table.take(pa.array(order[keep])), i[keep], t[keep]


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and their offsets."""
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)], np.append(0, ends)


def _unlike(data: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Which spans of the same size, from ``one`` and from ``two``, differ in a byte."""
    out = np.zeros(len(one), bool)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(one):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_once)))
        a, offsets = _gathered(data, one[begin:end], sizes[begin:end])
        b, _ = _gathered(data, two[begin:end], sizes[begin:end])
        out[begin:end] = np.logical_or.reduceat(a != b, offsets[:-1])
        begin = end
    return out


def _send(length: int, gram: int):
    """Step 2: a shard's contexts of the anchors that are left, to rows of ``_SENT``."""

    def run(docs: pa.Table, left: pa.Table) -> pa.Table:
        docs, ids, ties = _documents_of(docs)
        known = np.sort(left["anchor"].to_numpy())
        make, parts, texts, rows, base = Anchors(length, gram), [], [], 0, 0
        for batch in docs.select(["text"]).combine_chunks().to_batches() if len(known) else ():
            for part in slices(batch, "text", 1 << 19):
                data, offsets = text_buffer(part.column("text"))
                found = make.find(data, offsets)
                slot = np.minimum(np.searchsorted(known, found["anchor"]), len(known) - 1)
                pick = known[slot] == found["anchor"]
                found = {k: v[pick] for k, v in found.items()}
                found["row"], found["at"] = found["row"] + rows, found["at"] + base
                rows, base = rows + part.num_rows, base + len(data)
                parts.append(found)
                texts.append(data)
        if not parts or not sum(len(p["row"]) for p in parts):
            return pa.Table.from_batches([], schema=_schema(_SENT))
        whole = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        data = np.concatenate(texts)
        sizes = whole["last"] - whole["first"] + length
        order = np.lexsort((whole["at"], sizes, whole["context"], whole["anchor"]))
        a, c, size, at = whole["anchor"][order], whole["context"][order], sizes[order], whole["at"][order]
        head = np.ones(len(order), bool)
        head[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (size[1:] != size[:-1])
        same = np.flatnonzero(~head)
        head[same[_unlike(data, at[same], at[same - 1], size[same])]] = True
        heads = np.flatnonzero(head)
        place = whole["row"][order] << 32 | whole["first"][order]
        h = order[heads]
        doc, shard = whole["row"][h], docs["shard"][0].as_py()
        counts = np.diff(np.append(heads, len(order)))
        body, offsets = _gathered(data, whole["at"][h], sizes[h])
        columns = [
            pa.array(whole["anchor"][h]), pa.array(np.full(len(h), shard), pa.int32()), pa.array(ids[doc]), pa.array(ties[doc]), pa.array(whole["first"][h], pa.int32()), pa.array(whole["gram"][h], pa.int32()),
            pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)]),
            pa.array(place[heads]), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts - 1)), pa.int32()), pa.array(place[~head])),
        ]
        give_back()
        return pa.table(columns, schema=_schema(_SENT))

    return run


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _united(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching [first, last) of a row become one."""
    if not len(row):
        return row, first, last
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    far = int(last.max()) + 1
    reach = np.maximum.accumulate(row.astype(np.int64) * far + last) if int(row.max()) < (1 << 62) // far else None
    begin = np.ones(len(row), bool)
    if reach is None:
        raise OverflowError("row numbers and lengths don't fit into one key")
    begin[1:] = row[1:].astype(np.int64) * far + first[1:] > reach[:-1]
    heads = np.flatnonzero(begin)
    tails = np.append(heads[1:], len(row)) - 1
    return row[heads], first[heads], reach[tails] - row[heads].astype(np.int64) * far


def _judge(length: int, forward: bool = False):
    """Step 3: rows of ``_SENT`` of one task, to the bytes to remove (``_SPAN``). ``forward``: to the earliest row of each different context instead, which the other groups of shards are judged with."""

    def run(table: pa.Table) -> pa.Table:
        anchor, doc_id, tie, first, place = (table[c].to_numpy() for c in ("anchor", "doc_id", "tie", "first", "place"))
        bodies = table["body"].combine_chunks()
        data, offsets = text_buffer(bodies)
        begins, sizes = offsets[:-1], np.diff(offsets)
        order = np.lexsort((first, tie, doc_id, sizes, ByteHasher().spans(data, begins, offsets[1:]), anchor))
        a, size = anchor[order], sizes[order]
        # contexts: runs of equal rows, the earliest first
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (size[1:] != size[:-1])
        same = np.flatnonzero(~new)
        new[same[_unlike(data, begins[order[same]], begins[order[same - 1]], size[same])]] = True
        heads = np.flatnonzero(new)
        if forward:
            return table.take(pa.array(order[heads]))
        kind = np.cumsum(new) - 1
        more = table["others"].combine_chunks()
        other_counts = more.value_lengths().fill_null(0).to_numpy()
        weights = np.bincount(kind, other_counts[order] + 1).astype(np.int64)
        # anchors of one place in all take no part
        of = a[heads]
        key = np.append(True, of[1:] != of[:-1])
        several = np.bincount(np.cumsum(key) - 1, weights) > 1
        take = np.flatnonzero(several[np.cumsum(key) - 1])
        doc = _ranks(doc_id, tie)
        spans = []
        begin, reach = 0, np.cumsum(size[heads][take] + 1)
        cut = np.append(np.flatnonzero(key[take]) if len(take) else [], len(take)).astype(np.int64)
        at = 0
        while at < len(cut) - 1:  # anchors together, about MERGE_BYTES at once
            base = reach[cut[at] - 1] if cut[at] else 0
            end = max(at + 1, int(np.searchsorted(reach[cut[1:] - 1], base + MERGE_BYTES, side="right")))
            kinds = take[cut[at] : cut[end]]
            at = end
            string, offset, group = _repeated(bodies, order[heads[kinds]], size[heads[kinds]], weights[kinds], length)
            row = order[heads[kinds[string]]]
            # the earliest place of each string stays
            where = first[row] + offset
            by = np.lexsort((where, doc[row], group))
            again = np.zeros(len(by), bool)
            again[1:] = group[by][1:] == group[by][:-1]
            later = by[again]
            spans.append((row[later], place[row[later]] + offset[later], np.full(len(later), length)))
            # and all places of contexts equal to an earlier one go, string by string as found
            whole = kinds[np.bincount(string, minlength=len(kinds)) == size[heads[kinds]] - length + 1]
            whole = whole[weights[whole] > 1]
            member = np.isin(kind, whole)
            spans.append((order[member & ~new], place[order[member & ~new]], size[member & ~new]))
            inside = order[member & (other_counts[order] > 0)]
            spans.append((np.repeat(inside, other_counts[inside]), more.take(pa.array(inside)).flatten().to_numpy(), np.repeat(sizes[inside], other_counts[inside])))
        row, where, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
        shard = table["shard"].to_numpy()[row].astype(np.int64)
        key, begin, end = _united(shard << 32 | where >> 32, where & 0xFFFFFFFF, (where & 0xFFFFFFFF) + n)
        give_back()
        return pa.table([pa.array(key >> 32, pa.int32()), pa.array(key & 0xFFFFFFFF, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], schema=_schema(_SPAN))

    return run


def _repeated(bodies: pa.Array, rows: np.ndarray, sizes: np.ndarray, weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Builds the transforms of shards of contexts and merges them: the repeated strings as (context, offset, interval)."""
    strings = bodies.take(pa.array(rows)).to_pylist()
    reach = np.cumsum(sizes + 1)
    parts = min(max(2, -(-int(reach[-1]) // SUFFIX_BYTES)), len(rows))
    cuts = sorted({0, len(rows), *np.searchsorted(reach, [int(reach[-1]) * i // parts for i in range(1, parts)]).tolist()})
    return repeats([shard_bwt(strings[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], weights, length)


def _ranks(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    order = np.lexsort((ties, ids))
    i, t = ids[order], ties[order]
    new = np.zeros(len(i), np.int64)
    new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
    out = np.empty(len(i), np.int64)
    out[order] = np.cumsum(new)
    return out


def _refined(hot: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """Contexts of hot anchors, cut by where the anchor stands in their strings until at most ``most`` rows share one, or single strings are left."""
    # l, the bytes of a string before its anchor, is within [low, high]; all strings then have the bytes from gram - low to gram - high + length
    now = hot.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - gram))
    done = None
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b")))
        cut = now.withColumn("half", F.explode(halves)).withColumn("from", F.greatest(F.lit(0), F.col("gram") - F.col("half.b"))).withColumn("to", F.least(F.octet_length("body") - length, F.col("gram") - F.col("half.a")))
        core = F.substring(F.col("body"), F.col("gram") - F.col("half.a") + 1, F.col("half.a") - F.col("half.b") + length)
        cut = cut.filter("from <= to").select(
            F.xxhash64("anchor", "half", core).alias("anchor"), "shard", "doc_id", "tie", (F.col("first") + F.col("from")).alias("first"), (F.col("gram") - F.col("from")).alias("gram"),
            F.substring(F.col("body"), F.col("from") + 1, F.col("to") - F.col("from") + length).alias("body"), (F.col("place") + F.col("from")).alias("place"),
            F.transform("others", lambda x: x + F.col("from")).alias("others"), F.col("half.a").alias("low"), F.col("half.b").alias("high"),
        )
        cut = materialise(cut, "refined")
        every = materialise(cut.groupBy("anchor").agg(F.count("*").alias("rows"), F.sum(F.size("others") + 1).alias("places")).filter("places > 1"), "counts")
        cut = cut.join(every, "anchor")
        ready = cut.filter((F.col("rows") <= most) | (F.col("low") == F.col("high")))
        ready = ready.select(*hot.columns, (F.col("rows") > most).alias("still"))
        done = ready if done is None else done.unionByName(ready)
        now = cut.filter((F.col("rows") > most) & (F.col("low") < F.col("high"))).drop("rows", "places")
        if now.isEmpty():
            return done


def _cut(rest: list[str], keep_text: bool):
    """Step 4: a shard's rows and what is removed of them."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        ids = docs["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        number = _ranks(ids, docs["tie"].to_numpy())
        doc, first, last = _united(*(spans[c].to_numpy().astype(np.int64) for c in ("doc", "first", "last")))
        begin, end = np.searchsorted(doc, number), np.searchsorted(doc, number, side="right")
        kept, sizes, removed, counts = [], [], [], []
        texts = docs["text"]
        for n in range(len(number)):
            data = (texts[n].as_py() or "").encode()
            at, parts = 0, []
            for k in range(begin[n], end[n]):
                parts.append(data[at : first[k]])
                at = last[k]
            parts.append(data[at:])
            left = b"".join(parts)
            kept.append(left if keep_text else hashlib.sha256(left).hexdigest())
            sizes.append(len(data))
            removed.append(len(data) - len(left))
            counts.append(int(end[n] - begin[n]))
        give_back()
        made = [pa.array(kept, pa.binary() if keep_text else pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())]
        return pa.table([*(docs[c] for c in rest), *made], names=[*rest, "kept", "n_bytes", "n_removed", "n_spans"])

    return run


def dedup(df: DataFrame, keep_text: bool = True, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot: int = HOT, shard_group: int = SHARD_GROUP, few_shards: int = FEW_SHARDS) -> DataFrame:
    """``df`` (doc_id, text and others, all kept but text) with ``kept`` (the bytes left, or their SHA-256 in hex if not ``keep_text``), n_bytes, n_removed and n_spans."""
    made = ("kept", "n_bytes", "n_removed", "n_spans")
    rest = [c for c in df.columns if c not in ("text", *made)]
    inner = {c: c if c == "doc_id" else f"_c{i}" for i, c in enumerate(rest)}
    total = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // shard_bytes))
    docs = df.select(*[F.col(f"`{c}`").cast("long").alias(n) if c == "doc_id" else F.col(f"`{c}`").alias(n) for c, n in inner.items()], "text")
    docs = docs.withColumn("tie", F.xxhash64("text")).withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    anchors = docs.select("text", "shard").mapInArrow(_anchor_rows(length, gram), "anchor long, shard int, n int, kinds int")
    if shards <= few_shards:  # one small row of an anchor for each shard, at most: they are counted side by side
        window = Window.partitionBy("anchor")
        left = anchors.withColumns({"every": F.sum("n").over(window), "rows": F.sum("kinds").over(window)}).filter("every > 1")
    else:  # counted by partial sums and joined back, so that an anchor that every shard has is in no one task
        anchors = materialise(anchors, "places")
        left = anchors.join(anchors.groupBy("anchor").agg(F.sum("n").alias("every"), F.sum("kinds").alias("rows")).filter("every > 1"), "anchor")
    left = materialise(left.select("anchor", F.col("shard").alias("at_shard"), (F.col("rows") > hot).alias("hot")).distinct(), "anchors")
    # this pass over the texts and the last one read one exchange
    sent = docs.groupBy("shard").cogroup(left.filter("not hot").groupBy("at_shard")).applyInArrow(_send(length, gram), _SENT)
    bucket = F.pmod("anchor", F.lit(shards)).cast("int")
    spans = sent.groupBy(bucket).applyInArrow(_judge(length), _SPAN)
    hot_left = left.filter("hot")
    if not hot_left.isEmpty():
        crowded = materialise(docs.groupBy("shard").cogroup(hot_left.groupBy("at_shard")).applyInArrow(_send(length, gram), _SENT), "crowded")
        crowded = materialise(_refined(crowded, length, gram, hot), "refined")
        spans = spans.unionByName(crowded.filter("not still").select(*sent.columns).groupBy(bucket).applyInArrow(_judge(length), _SPAN))
        still = crowded.filter("still").select(*sent.columns)
        group = F.floor(F.col("shard") / shard_group)
        spans = spans.unionByName(still.groupBy(bucket, group).applyInArrow(_judge(length), _SPAN))
        heads = still.groupBy(bucket, group).applyInArrow(_judge(length, forward=True), _SENT)
        spans = spans.unionByName(heads.withColumn("others", F.array().cast("array<bigint>")).groupBy(bucket).applyInArrow(_judge(length), _SPAN))
    spans = spans.withColumnRenamed("shard", "at_shard")
    kind = T.BinaryType() if keep_text else T.StringType()
    schema = T.StructType([*(docs.schema[n] for n in inner.values()), T.StructField("kept", kind), *(T.StructField(c, T.LongType()) for c in made[1:])])
    cut = docs.groupBy("shard").cogroup(spans.groupBy("at_shard")).applyInArrow(_cut(list(inner.values()), keep_text), schema)
    return cut.select(*[F.col(n).cast(df.schema[c].dataType).alias(c) for c, n in inner.items()], *made)
