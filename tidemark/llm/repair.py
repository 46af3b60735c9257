"""Repair of the structure of conversations by an auction for shortest paths.

A sound conversation's roles are ``(s?(ua)+)?``: a system turn perhaps, then user and assistant in turn. Every row is kept (0), given the role user or assistant (3) or deleted (4, a must for blank and
duplicate rows); a truncated row that stays costs 3 more; a turn of user or assistant without text can be put in anywhere (3). These edits are the arcs of a lattice: its layers are the
places between rows, and a layer's nodes are what the repaired conversation ends with so far (nothing, s, u or a).

Nodes carry integer prices that never exceed an arc's cost plus the price at its end. An auction's path starts at a node and is extended over the arc that attains its
node's price; where none does, the price is raised to the least and the path contracted. It ends where prices have converged. Layers are solved from the last to the
first, so that a path never leaves its layer by more than an arc; converged prices are the costs of the cheapest repair from there. Arcs whose cost is the
difference of prices are tight: all cheapest repairs run over tight arcs, and as a letter leads from a node to one node only, the least letter at each
node traces the repair that comes first in the alphabet.

A layer's prices depend on its row's kind and on the differences of the next layer's, which are few; each such auction runs once in a process. A
conversation holds a byte for each row (and prices of every ``BLOCK``-th layer); its texts pass through, sorted by Spark, when the repaired conversation is
digested. Only digests and flags of the texts are shuffled for the auction itself, and the texts once.

Nulls in role or text, and null ids and turns where a row's damage is dealt, are one space. Rows go by turn (null first), those of one turn by a digest of role and text, repeated rows
side by side. Rows without a conv_id are one conversation. An empty table has no conversation; one whose rows have all been dropped has zeros. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows between layers whose prices are held, and rows of a batch that a task gives back.
BLOCK, BATCH = 4096, 4096
#: Costs of the edits.
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
_NOTHING, _S, _U, _A = range(4)
#: A row's kind is 3 times the class of its role's initial (s, u, a, other) plus 0, or 1 if it has to go, or 2 if it is truncated. The end is a kind of its own.
_CLASS, _END = {"s": 0, "u": 1, "a": 2}, 12
_AFTER = {_NOTHING: _U, _S: _U, _U: _A, _A: _U}
_ROLE = {_U: "user", _A: "assistant"}


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone): rows as the damage leaves them; ``gone`` ones are dropped."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    x = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(x == 1, "").when(x == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.when(x == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.select("conv_id", "turn", F.when(x == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copy"), (x == 0).alias("gone"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copy, gone) as (…, digest, kind, fault) without role and text; fault: the first of blank, duplicate, truncated, or none."""
    bare = F.rtrim("text", F.lit(_SPACE))
    digest = digest_of_row()
    blank = bare == ""
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = rows.select("conv_id", "turn", "copy", "gone", digest.alias("digest"), letter.alias("letter"), blank.alias("blank"), cut.alias("cut"))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "digest").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    return light.select("conv_id", "turn", "copy", "gone", "digest", "letter", fault.alias("fault"))


def digest_of_row():
    return F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))


@lru_cache(None)
def arcs(kind: int, node: int) -> tuple[tuple[str, int, bool, int], ...]:
    """(letter, cost, whether into the next layer, node at its end) of a layer's node; at the end the letter is empty."""
    out = []
    if kind == _END:
        if node in (_NOTHING, _A):
            out.append(("", 0, True, _NOTHING))
    else:
        initial, state = divmod(kind, 3)
        out.append(("D", DELETE, True, node))
        if state != 1:
            more = CUT if state == 2 else 0
            to = (_S, _U, _A)[initial] if initial < 3 else None
            if to is not None and (to == _AFTER[node] or to == _S and node == _NOTHING):
                out.append(("K", more, True, to))
            out.append(("R", RENAME + more, True, _AFTER[node]))
    out.append(("I", INSERT, False, _AFTER[node]))
    return tuple(out)


@lru_cache(1 << 16)
def layer(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """A layer's converged prices by auctions from each of its nodes, and each node's least tight letter with the node that it leads to. ``after``: the next layer's converged prices, the least of them 0."""
    price, done = [0, 0, 0, 0], set()

    def reach(arc):
        return arc[1] + (after[arc[3]] if arc[2] else price[arc[3]])

    for origin in (_NOTHING, _S, _U, _A):
        path = [] if origin in done else [origin]
        while path:
            node = path[-1]
            best = min(arcs(kind, node), key=reach)
            if price[node] < reach(best):
                price[node] = reach(best)
                if len(path) > 1:
                    path.pop()
            elif best[2] or best[3] in done:
                done.update(path)
                path = []
            else:
                path.append(best[3])
    tight = [min((arc for arc in arcs(kind, n) if reach(arc) == price[n]), key=lambda arc: arc[0]) for n in range(4)]
    return tuple(price), tuple((arc[0], arc[3]) for arc in tight)


def _step(kind: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """What all prices of a layer have in common, and their differences to it."""
    price = layer(kind, after)[0]
    low = min(price)
    return low, tuple(p - low for p in price)


def cheapest(kinds: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The least cost to repair a conversation of these kinds of rows, and the edits' letters, the first in the alphabet of all that cost as little."""
    base, now = _step(_END, (0, 0, 0, 0))
    held = {len(kinds): now}
    for i in range(len(kinds) - 1, -1, -1):
        more, now = _step(kinds[i], now)
        base += more
        if i % block == 0:
            held[i] = now
    cost, out, node = base + now[_NOTHING], [], _NOTHING
    for first in range(0, len(kinds), block):
        last = min(first + block, len(kinds))
        prices = [held[last]]
        for i in range(last - 1, first, -1):
            prices.append(_step(kinds[i], prices[-1])[1])
        for i in range(first, last):
            after = prices.pop()
            letter = ""
            while letter in ("", "I"):
                letter, node = layer(kinds[i], after)[1][node]
                out.append(letter)
    letter = "I"
    while letter:
        letter, node = layer(_END, (0, 0, 0, 0))[1][node]
        out.append(letter)
    return cost, "".join(out)


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(id_type: T.DataType):
    """Rows' faults, sorted by conversation, ``gone`` and order, to a summary of each conversation."""

    def run(batches):
        none, out = object(), []
        now, kinds, counts, illegal, turns, ends, last = none, bytearray(), [0] * 4, 0, 0, (None, None), 3

        def summary():
            cost, audit = cheapest(bytes(kinds))
            gaps = ends[1] - ends[0] + 1 - turns if turns else 0
            return (now, gaps, *counts[1:], illegal, cost, audit)

        for batch in batches:
            for conv, turn, gone, letter, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "gone", "letter", "fault")), strict=True):
                if now is none or conv != now:
                    if now is not none:
                        out.append(summary())
                    now, kinds, counts, illegal, turns, ends = conv, bytearray(), [0] * 4, 0, 0, (None, None)
                if gone:
                    continue
                if kinds and (last, letter) not in _LEGAL:
                    illegal += 1
                last = letter
                counts[fault] += 1
                kinds.append(3 * letter + (0, 1, 1, 2)[fault])
                if turn is not None and turn != ends[1]:
                    turns, ends = turns + 1, (turn if turns == 0 else ends[0], turn)
                if len(out) >= BATCH:
                    yield _rows(out)
                    out = []
        if now is not none:
            out.append(summary())
        if out:
            yield _rows(out)

    _LEGAL = {(0, 1), (1, 2), (2, 1)}
    schema = pa.schema([("conv_id", to_arrow_type(id_type)), *((c, pa.int64()) for c in _SUMMARY), ("audit", pa.string())])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _repaired(names: list[str]):
    """A conversation's summary, then its rows in order, to the summary with the repaired conversation's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = text = None
        at = node = 0
        for batch in batches:
            done, kinds = [], batch.schema
            heads = batch.column("head").to_pylist()
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            columns = [batch.column(c).to_pylist() for c in names]
            for i, head in enumerate(heads):
                if head:
                    if held is not None:
                        done.append((*held, text.end(at, node)))
                    held, text, at, node = tuple(c[i] for c in columns), Repaired(columns[-1][i]), 0, _NOTHING
                else:
                    at, node = text.row(at, node, roles[i], texts[i])
            if done:
                yield _out(done, kinds)
        if held is not None:
            yield _out([(*held, text.end(at, node))], kinds)

    def _out(rows, kinds):
        types = [kinds.field(c).type for c in names] + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*names, "repaired_sha256"])

    return run


class Repaired:
    """The digest of one repaired conversation, fed row by row."""

    def __init__(self, audit: str) -> None:
        self.audit, self._run, self._any = audit, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self._run.update((b"\n" if self._any else b"") + f"{role}:{text}".encode())
        self._any = True

    def _inserted(self, at: int, node: int) -> tuple[int, int]:
        while at < len(self.audit) and self.audit[at] == "I":
            node = _AFTER[node]
            self._put(_ROLE[node], "")
            at += 1
        return at, node

    def row(self, at: int, node: int, role: str, text: str) -> tuple[int, int]:
        at, node = self._inserted(at, node)
        letter = self.audit[at]
        if letter == "K":
            node = _CLASS[role[0]] + 1
            self._put(role, text)
        elif letter == "R":
            node = _AFTER[node]
            self._put(_ROLE[node], text)
        return at + 1, node

    def end(self, at: int, node: int) -> str:
        self._inserted(at, node)
        return self._run.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """The summary of each conversation of ``rows`` (conv_id, turn, role, text, copy, gone; neither role nor text null): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["conv_id"].dataType
    names = ["conv_id", *_SUMMARY, "audit"]
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in _SUMMARY), T.StructField("audit", T.StringType())])
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "copy"]
    faults = with_faults(rows).repartition("conv_id").sortWithinPartitions(order[0], "gone", *order[1:])
    audits = faults.mapInArrow(_audits(kind), schema)
    texts = rows.filter(~F.col("gone")).select("conv_id", F.lit(False).alias("head"), "turn", digest_of_row().alias("digest"), "copy", "role", "text")
    both = audits.withColumn("head", F.lit(True)).unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions(order[0], F.desc("head"), *order[1:])
    return both.mapInArrow(_repaired(names), T.StructType([*schema, T.StructField("repaired_sha256", T.StringType())]))
