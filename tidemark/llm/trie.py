"""Prefix trie of conversations: the distinct beginnings of all of them, with totals of their subtrees by time-forward processing.

A node is a distinct sequence of first turns (role, text); the root is the sequence of none. Its members are the conversations that begin with it, its
``conv_id`` is the least of them. The nodes whose least member is m are a run of m's turns, m's chain; its top hangs on a chain of a smaller id.

1. Each conversation's turns, in order, become the keys of its nodes: a running 128-bit digest of all turns so far. Texts are digested where
   they are read; only digests and word counts are shuffled. Rows of a node are counted by partial aggregates, so a first turn or a
   conversation that a third of all have is no task of its own.
2. The nodes are dealt into shards by ranges of (first turn, chain), so that a common first turn spreads over shards and a chain stays whole. Spark sorts each shard
   in reverse level order, externally. A task goes through it once: a node takes the messages to it out of a priority queue, adds its own share and sends the total
   to its parent. The queue keeps ``QUEUE`` messages in memory and spills the others as sorted runs, which are merged as they are read.
3. Messages to parents in other shards leave the task. They are summed by the place they go to, and climb from the top of each chain to the chain it
   hangs on until all are at the root: a round is a join with the chains' tops and an aggregate, and there are as many as chains on the longest way. What has arrived at a chain's
   turns is summed from below and added to the totals.

Turns go by ``turn`` (null first), rows of one turn by a digest of role and text; equal rows are turns of their own. Null role or text is empty. Rows without a conv_id belong to no
conversation and are left out; ids are whole numbers, negative ones too. An empty table has no node, not even a root. Columns other than the four are ignored. One conversation's turns are
streamed through one task in bounded memory, some 40 bytes each when they are sorted, whatever their texts.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Messages that a queue holds in memory, ids in one piece of a node's list of ends, and rows of a batch that a task gives back.
QUEUE, PIECE, BATCH = 1 << 18, 4096, 8192
#: Key of the root.
ROOT = bytes(16)


def digest_of(role="role", text="text"):
    """A 128-bit digest of role and text, null as empty; the role's length keeps them apart."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    return F.unhex(F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))


def words_of(text="text"):
    """Runs of characters other than ASCII white space."""
    return F.size(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), " ")) - F.when(F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), 0).otherwise(1)


def light_turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): the turns in order, places from 0, without their texts."""
    rows = df.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest_of().alias("digest"), words_of().cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c as the first h turns of conversation c - c % ``every``, then its own after its first h; h is the CRC-32 of c in decimal modulo ``most``. (conv_id, place, digest, words); places have gaps."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.filter(F.col("place") >= h).select("conv_id", (F.col("place") + most).alias("place"), "digest", "words")
    ids = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"))
    heads = turns.filter((F.col("place") < most - 1) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    lent = ids.join(heads, "base").filter(F.col("place") < F.col("h")).select("conv_id", "place", "digest", "words")
    return lent.unionByName(own)


_MEMBER = "key binary, parent binary, first binary, depth long, conv_id long, words long, last boolean"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation and place to their nodes' keys."""
    now, run, key, first, depth, out = None, None, ROOT, ROOT, 0, []
    held = None
    for batch in batches:
        for conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words")), strict=True):
            if held is not None:
                out.append((*held, conv != now))
            if conv != now:
                now, run, key, depth = conv, hashlib.blake2b(digest_size=16), ROOT, 0
            run.update(digest)
            parent, depth = key, depth + 1
            key = run.digest()
            if depth == 1:
                first = key
            held = (key, parent, first, depth, conv, words)
            if len(out) >= BATCH:
                yield _batch(out, _MEMBER_TYPES)
                out = []
    if held is not None:
        out.append((*held, True))
    if out:
        yield _batch(out, _MEMBER_TYPES)


def _types(ddl: str) -> pa.Schema:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class SpillingQueue:
    """A priority queue of (level, key, leaves, tokens, chain) that holds up to ``most`` messages in memory and the others in sorted runs of anonymous files, which end with the task."""

    def __init__(self, most: int = QUEUE) -> None:
        self.most, self._heap, self._runs = most, [], []
        self.spilled = 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self._heap, message)
        if len(self._heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # noqa: SIM115
        now = None
        for m in sorted(self._heap):
            if now and now[:2] == m[:2]:
                now = (*now[:2], now[2] + m[2], now[3] + m[3], now[4])
                continue
            if now:
                pickle.dump(now, file)
            now = m
        pickle.dump(now, file)
        pickle.dump(None, file)
        file.seek(0)
        self.spilled += 1
        self._heap = []
        self._more(file)
        if len(self._runs) > 64:
            one = tempfile.TemporaryFile()  # noqa: SIM115
            while self._runs:
                pickle.dump(self._pop_run(), one)
            pickle.dump(None, one)
            one.seek(0)
            self._more(one)

    def _more(self, file) -> None:
        if (m := pickle.load(file)) is not None:
            heapq.heappush(self._runs, (m, id(file), file))

    def _pop_run(self) -> tuple:
        m, _, file = heapq.heappop(self._runs)
        self._more(file)
        return m

    def first(self) -> tuple | None:
        """The least message, which stays."""
        if self._heap and (not self._runs or self._heap[0] <= self._runs[0][0]):
            return self._heap[0]
        return self._runs[0][0] if self._runs else None

    def pop(self) -> tuple:
        if self._heap and (not self._runs or self._heap[0] <= self._runs[0][0]):
            return heapq.heappop(self._heap)
        return self._pop_run()


_TOTAL = "key binary, conv_id long, depth long, leaves long, tokens long, sent boolean"


def _forward(queue: int):
    """Nodes of a shard in reverse level order to their totals, and messages to nodes of other shards (``sent``: to the turn ``depth`` of chain ``conv_id``)."""

    def run(batches):
        # a message names its parent by level and key, and carries the parent's chain for the case that it leaves the shard
        waiting, out = SpillingQueue(queue), []

        def leave(message):
            out.append((None, message[4], -message[0], message[2], message[3], True))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("depth", "key", "parent", "conv_id", "parent_conv_id", "leaf", "own"))
            for depth, key, parent, conv, parent_conv, leaf, own in zip(*columns, strict=True):
                place = (-depth, key)
                while (m := waiting.first()) is not None and m[:2] < place:
                    leave(waiting.pop())
                leaves, tokens = int(leaf), own
                while (m := waiting.first()) is not None and m[:2] == place:
                    waiting.pop()
                    leaves, tokens = leaves + m[2], tokens + m[3]
                out.append((key, conv, depth, leaves, tokens, False))
                waiting.push((1 - depth, parent, leaves, tokens, parent_conv))
                if len(out) >= BATCH:
                    yield _batch(out, _TOTAL_TYPES)
                    out.clear()
        while waiting.first() is not None:
            leave(waiting.pop())
            if len(out) >= BATCH:
                yield _batch(out, _TOTAL_TYPES)
                out.clear()
        if out:
            yield _batch(out, _TOTAL_TYPES)

    return run


_ENDS, _HASHED = "key binary, least long, ids string", "key binary, ends_sha256 string"
_MEMBER_TYPES, _TOTAL_TYPES, _ENDS_TYPES, _HASHED_TYPES = map(_types, (_MEMBER, _TOTAL, _ENDS, _HASHED))


def _pieces(piece: int):
    """(key, conv_id), sorted, to pieces of each key's list."""

    def run(batches):
        now, ids, out = None, [], []
        for batch in batches:
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (key != now or len(ids) >= piece):
                    out.append((now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = key
                ids.append(conv)
                if len(out) >= BATCH // 8:
                    yield _batch(out, _ENDS_TYPES)
                    out = []
        if ids:
            out.append((now, ids[0], ",".join(map(str, ids))))
        if out:
            yield _batch(out, _ENDS_TYPES)

    return run


def _hashed(batches):
    """Pieces, sorted by key and least id, to a digest for each key."""
    now, run, out = None, None, []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if run is not None:
                    out.append((now, run.hexdigest()))
                now, run = key, hashlib.sha256(ids.encode())
            else:
                run.update(b"," + ids.encode())
            if len(out) >= BATCH:
                yield _batch(out, _HASHED_TYPES)
                out = []
    if run is not None:
        out.append((now, run.hexdigest()))
    if out:
        yield _batch(out, _HASHED_TYPES)


def _ends(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, ends_sha256) of nodes that conversations end at. Ranges of (key, id) are joined to pieces in all tasks; a node's pieces are then digested one after another."""
    pieces = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces(piece), _ENDS)
    return pieces.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_hashed, _HASHED)


def trie(turns: DataFrame, ids: DataFrame, queue: int = QUEUE, piece: int = PIECE) -> DataFrame:
    """The nodes of conversations. ``turns``: conv_id, place, digest, words, in any order; ``ids``: all conversations (conv_id, distinct), those without turns too.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    ordered = turns.select("conv_id", "place", "digest", "words").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    members = materialise(ordered.mapInArrow(_members, _MEMBER), "members")
    nodes = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("first").alias("first"), F.min("depth").alias("depth"), F.min("words").alias("words"))
    nodes = materialise(nodes, "nodes")
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    least = ids.agg(F.min("conv_id")).first()[0]
    root = F.lit(least).cast("long")
    # a parent's chain, and the number of children: both sides are written tables, so that the many children of one node are split among tasks
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").join(above, "parent", "left")
    nodes = nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("parent_conv_id", F.coalesce("parent_conv_id", root))
    nodes = materialise(nodes.withColumn("leaf", F.col("n_children") == 0).withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "linked")
    shards = nodes.select("first", "depth", "key", "parent", "conv_id", "parent_conv_id", "leaf", "own").repartitionByRange("first", "conv_id").sortWithinPartitions(F.desc("depth"), "key")
    passed = materialise(shards.mapInArrow(_forward(queue), _TOTAL), "totals")
    # across shards
    going = ["conv_id", "depth"]
    sums = [F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens")]
    tops = nodes.filter((F.col("depth") == 1) | (F.col("parent_conv_id") != F.col("conv_id"))).select("conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at"))
    tops = materialise(tops, "tops")
    now = materialise(passed.filter("sent").groupBy(*going).agg(*sums), "sent")
    arrived, at_root = None, [now.filter("depth = 0")]
    while True:
        now = now.filter("depth > 0")
        if now.isEmpty():
            break
        arrived = now if arrived is None else arrived.unionByName(now)
        now = materialise(now.groupBy("conv_id").agg(*sums).join(tops, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(*sums), "sent")
        at_root.append(now.filter("depth = 0"))
    totals = passed.filter("NOT sent").select("key", *going, "leaves", "tokens")
    if arrived is not None:
        below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        came = arrived.select(F.lit(None).cast("binary").alias("key"), *going, "leaves", "tokens")
        extra = {c: F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col(c))).over(below), F.lit(0)) for c in ("leaves", "tokens")}
        totals = totals.unionByName(came).withColumns({f"more_{c}": v for c, v in extra.items()}).filter("key IS NOT NULL")
        totals = totals.select("key", (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("tokens") + F.col("more_tokens")).alias("tokens"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(totals.select("key", "leaves", "tokens"), "key").join(_ends(members.filter("last").select("key", "conv_id"), piece), "key", "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")]
    found = found.select(*out)
    # the root: all conversations, ends of those without turns
    to_root = at_root[0]
    for more in at_root[1:]:
        to_root = to_root.unionByName(more)
    totals = to_root.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    silent = ids.join(members.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("key"), "conv_id")
    ended = _ends(silent, piece).first()
    tops_n = tops.filter("at = 0").count()
    row = ids.agg(F.count("*").alias("n_convs")).filter("n_convs > 0")
    first = row.select(
        root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(tops_n).cast("long").alias("n_children"),
        F.lit(totals["leaves"] if tops_n else 1).cast("long").alias("n_leaves"), F.lit(totals["tokens"]).cast("long").alias("saved_tokens"), F.lit(ended["ends_sha256"]).alias("ends_sha256") if ended else none.alias("ends_sha256"),
    )
    return found.unionByName(first)
