"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

A shard is a collection of byte strings, each ended by a terminator of its own that sorts before all bytes, in order of the
strings. ``shard_bwt`` sorts its suffixes once. ``merge`` never sorts suffixes again: it begins with the shards one after another, which
is the order of all suffixes by no symbol; a pass takes the rows in the present order and deals their predecessors (the
last-to-first mapping) out by the symbol before them, which gives the order by one symbol more. A boundary between neighbours first appears in the
pass that tells them apart, so the pass is the length of their common prefix plus one; runs of rows without a boundary after d passes are the intervals
of suffixes that share d bytes.

``repeats`` gives the repeated intervals only. A string may stand for several equal ones, which are neighbours in every order: it is in the transform
once, with its number (a run of that length). A row that is alone in its interval then is either unlike all others and leaves, or stands for
several equal suffixes; it leaves too, as what precedes it is the same for all of these: each suffix up to the string's start is an interval of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ShardBwt:
    """Rows in suffix order: ``symbols`` before each suffix (byte + 1; 0: the suffix is a whole string) and its place (string, offset)."""

    symbols: np.ndarray
    strings: np.ndarray
    offsets: np.ndarray
    n_strings: int


def shard_bwt(strings: list[bytes]) -> ShardBwt:
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths) - 1
    text = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).astype(np.int64) + 1
    text[ends] = 0
    # by a first key of three symbols, terminators being all different
    base = len(strings) + 256
    rank = text + len(strings) - 1
    rank[ends] = np.arange(len(strings))
    wide = np.concatenate([rank, [0, 0]])
    rank, tied = _ranked(np.arange(total), (wide[:-2] * base + wide[1:-1]) * base + wide[2:], np.zeros(total, np.int64), rank)
    step = 3
    while len(tied):
        after = rank[np.minimum(tied + step, total - 1)]
        rank, tied = _ranked(tied, after, rank[tied], rank)
        step *= 2
    order = np.empty(total, np.int64)
    order[rank] = np.arange(total)
    string = np.searchsorted(ends, order)
    offset = order - (ends[string] - lengths[string] + 1)
    return ShardBwt(np.where(offset > 0, text[order - 1], 0).astype(np.uint16), string, offset, len(strings))


def _ranked(places: np.ndarray, keys: np.ndarray, groups: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits groups (numbered by their first rank) by ``keys``; returns the ranks and the places still tied."""
    # one number for group and key; which of equal ones comes first doesn't matter
    order = np.argsort(groups * (int(keys.max(initial=0)) + 1) + keys if groups.any() else keys)
    p, k, g = places[order], keys[order], groups[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    new_group = np.ones(len(p), bool)
    new_group[1:] = g[1:] != g[:-1]
    at = np.arange(len(p))
    first = np.maximum.accumulate(np.where(new_group, at, 0))
    head = np.maximum.accumulate(np.where(fresh, at, 0))
    rank = rank.copy()
    rank[p] = g + head - first
    alone = fresh & np.append(fresh[1:], True)
    return rank, p[~alone]


@dataclass(frozen=True)
class Merged:
    """Rows of all shards (shard offset + row) in the order reached, with each row's common prefix with the one before it (capped at the depth), and starts of the intervals of equal prefixes."""

    rows: np.ndarray
    lcp: np.ndarray
    starts: np.ndarray


def last_to_first(shard: ShardBwt) -> np.ndarray:
    """The row of the suffix one symbol longer: its rank among rows with that symbol. Rows of whole strings map among the terminators and are never followed."""
    out = np.empty(len(shard.symbols), np.int64)
    out[np.argsort(shard.symbols, kind="stable")] = np.arange(len(shard.symbols))
    return out


def _joined(shards: list[ShardBwt]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (bytes where few enough), predecessors' rows and first row of each shard."""
    base = np.cumsum([0, *[len(s.symbols) for s in shards]])
    symbols = np.concatenate([s.symbols for s in shards]) if shards else np.zeros(0, np.uint16)
    if len(symbols) and symbols.max() > 255:  # as few symbols as there are, in order, so that each is a byte where that is enough
        kinds = np.flatnonzero(np.bincount(symbols))
        if len(kinds) < 256:
            small = np.zeros(int(kinds[-1]) + 1, np.uint8)
            small[kinds] = np.arange(len(kinds)) + (kinds[0] > 0)
            symbols = small[symbols]
    else:
        symbols = symbols.astype(np.uint8)
    before = np.concatenate([last_to_first(s) + b for s, b in zip(shards, base, strict=False)]).astype(np.int32) if shards else np.zeros(0, np.int32)
    return symbols, before, base


def _refined(rows: np.ndarray, fresh: np.ndarray, symbols: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass: the rows of the suffixes one symbol longer, in order, and where intervals begin."""
    by = symbols[rows]
    group = np.cumsum(fresh, dtype=np.int32)
    order = np.argsort(by, kind="stable")
    order = order[len(by) - np.count_nonzero(by) :]  # whole strings have nothing before them
    by, old = by[order], group[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (by[1:] != by[:-1]) | (old[1:] != old[:-1])
    return before[rows[order]], fresh


def merge(shards: list[ShardBwt], depth: int) -> Merged:
    """The interleave by prefixes of ``depth`` bytes."""
    symbols, before, base = _joined(shards)
    ends = np.concatenate([np.arange(s.n_strings) + b for s, b in zip(shards, base, strict=False)]).astype(np.int32) if shards else np.zeros(0, np.int32)
    rows = np.arange(len(symbols), dtype=np.int32)
    known = np.full(len(rows), -1, np.int32)  # common prefixes at boundaries; a boundary stays at its place
    fresh = np.zeros(len(rows), bool)
    fresh[:1] = True
    for d in range(1, depth + 1):
        rows, fresh = _refined(rows, fresh, symbols, before)
        # suffixes of a terminator only stand before all others, each alone
        rows = np.concatenate([ends, rows])
        fresh = np.concatenate([np.ones(len(ends), bool), fresh])
        known[fresh & (known < 0)] = d - 1
        if not len(rows):
            break
    lcp = np.where(known < 0, depth, known)
    lcp[:1] = 0
    return Merged(rows, lcp, np.flatnonzero(fresh))


def repeats(shards: list[ShardBwt], weights: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes whose first ``depth`` bytes occur more than once: their strings (numbered over all shards), offsets and intervals. ``weights``: how many equal strings each stands for."""
    symbols, before, _ = _joined(shards)
    firsts = np.cumsum([0, *[s.n_strings for s in shards]])
    strings = np.concatenate([s.strings + f for s, f in zip(shards, firsts, strict=False)]).astype(np.int32) if shards else np.zeros(0, np.int32)
    offsets = np.concatenate([s.offsets for s in shards]).astype(np.int32) if shards else np.zeros(0, np.int32)
    several = weights > 1
    rows = np.arange(len(symbols), dtype=np.int32)
    fresh = np.zeros(len(rows), bool)
    fresh[:1] = True
    alone_strings, alone_offsets = [], []
    for d in range(1, depth + 1):
        rows, fresh = _refined(rows, fresh, symbols, before)
        if not len(rows):
            break
        alone = fresh & np.append(fresh[1:], True)
        out = rows[alone]
        out = out[several[strings[out]]]
        at = offsets[out] - (depth - d)
        alone_strings.append(strings[out][at >= 0])
        alone_offsets.append(at[at >= 0])
        rows, fresh = rows[~alone], fresh[~alone]
    group = np.cumsum(fresh)
    n = int(group[-1]) if len(group) else 0
    s, o = (np.concatenate([*x, y[rows]]) for x, y in ((alone_strings, strings), (alone_offsets, offsets)))
    return s, o, np.concatenate([np.arange(len(s) - len(rows)) + n + 1, group])
