"""Token counts of a BPE vocabulary with word ends, by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch of texts lie one after another in one numpy array of symbol ids. A round finds the rank of every
neighbouring pair, takes the lowest of each pre-token, and merges all places of that pair in all pre-tokens at once. A
pre-token without a known pair leaves the array; its surviving symbols are its count. One pair at a time in order of rank
gives the same: a merge's symbol only takes part in pairs of a higher rank.

A word seen before isn't merged again: each process holds a table of counts of words up to ``SHORT`` bytes, bounded in words. A pre-token of
``LONG`` symbols and more is merged on its own: its pairs are kept by rank, and a round touches only the places of the lowest rank and
their neighbours, so that its work grows with its length and not with the number of rounds.

``count_tokens`` counts as the tokenizers library does with its defaults for files of this kind (normaliser NFC, white space
runs to one blank, lower case; pattern of contractions, letters, single digits and others; byte-level symbols; strings of
special tokens in a text are one token each, found before the text is normalised). No begin or end tokens, truncation or
padding. Null and empty texts have none. Repeated rows count alike, other columns are kept, an existing column of the output's
name is replaced, and one very long pre-token is merged like any other.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

#: Words that a process remembers, their most bytes, and symbols from which a pre-token is merged on its own.
REMEMBERED, SHORT, LONG = 1 << 19, 64, 2048


class RankMerger:
    """Merges of one vocabulary over ragged arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        for token in spec["added_tokens"]:
            if any(token.get(flag) for flag in ("lstrip", "rstrip", "single_word")):
                raise ValueError(f"added tokens that take in white space or need a word's edges aren't counted: {token['content']}")
        self.special = [x["content"] for x in spec["added_tokens"]]
        chars = _byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a.removesuffix(end) + b if a.endswith(end) else a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks, self._made = keys[order], order, made
        self._known: dict[bytes, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each word (UTF-8, none empty)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.inner[data]
        last = np.cumsum(lengths) - 1
        ids[last] = self.final[data[last]]
        out, word = np.ones(len(words), np.int64), np.arange(len(words))
        for i in np.flatnonzero(lengths >= LONG).tolist():
            out[i] = self._count_long(ids[last[i] - lengths[i] + 1 : last[i] + 1])
        word, lengths, ids = _keep((lengths > 1) & (lengths < LONG), word, lengths, ids)
        none = np.int64(len(self._keys))
        while len(word):
            firsts = np.cumsum(lengths) - lengths
            keys = np.empty(len(ids), np.int64)
            keys[:-1] = ids[:-1] << 32 | ids[1:]
            keys[firsts + lengths - 1] = -1  # no pair goes on into the next word
            ranks = self._ranks_of(keys)
            lowest = np.minimum.reduceat(ranks, firsts)
            done = lowest == none
            if done.any():
                out[word[done]] = lengths[done]
                pick = np.repeat(~done, lengths)
                word, lengths, lowest, ids, ranks = word[~done], lengths[~done], lowest[~done], ids[pick], ranks[pick]
                if not len(word):
                    break
            hits = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            if len(hits) > 1:  # of places that overlap, every other one from the left
                new = np.empty(len(hits), bool)
                new[0] = True
                new[1:] = (hits[1:] != hits[:-1] + 1) | (ranks[hits[1:]] != ranks[hits[:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))
                hits = hits[(np.arange(len(hits)) - start) % 2 == 0]
            ids[hits] = self._made[ranks[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            lengths = np.add.reduceat(keep.astype(np.int64), np.cumsum(lengths) - lengths)
            ids = ids[keep]
        return out

    def _ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of pairs (left << 32 | right); the number of merges for none."""
        none = np.int64(len(self._keys))
        at = np.minimum(np.searchsorted(self._keys, keys), none - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], none)

    def _count_long(self, ids: np.ndarray) -> int:
        """Symbols that survive in one pre-token, which is a linked list of places."""
        n, none = len(ids), len(self._keys)
        ids, after, before = ids.copy(), np.arange(1, n + 1), np.arange(-1, n)  # before has a place for the end
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks_left: list[int] = []

        def note(places: np.ndarray) -> None:
            ranks = self._ranks_of(ids[places] << 32 | ids[after[places]])
            places, ranks = places[ranks < none], ranks[ranks < none]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            heads = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            for a, b in zip(heads, [*heads[1:], len(ranks)], strict=True):
                rank = int(ranks[a])
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks_left, rank)
                waiting[rank].append(places[a:b])

        note(np.arange(n - 1))
        while ranks_left:
            rank = heapq.heappop(ranks_left)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (after[places] < n)]
            places = places[self._ranks_of(ids[places] << 32 | ids[after[places]]) == rank]  # the others have changed since
            if not len(places):
                continue
            if len(places) > 1:  # of places that overlap, every other one from the left
                new = np.append(True, places[1:] != after[places[:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - start) % 2 == 0]
            gone = after[places]
            ids[places] = self._made[rank]
            alive[gone] = False
            after[places] = after[gone]
            before[after[places]] = places
            near = np.unique(np.concatenate([before[places], places]))
            note(near[(near >= 0) & (after[near] < n)])
        return int(alive.sum())

    def count_texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        found, extra = [], []
        for text in texts:
            parts, special = self._apart(text or "")
            extra.append(special)
            found.append([w for part in parts for w in pre_tokens(part)])
        fresh = list({w for words in found for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self.counts([w.encode() for w in fresh]).tolist(), strict=True))
        out = [sum(map(known.__getitem__, words)) + more for words, more in zip(found, extra, strict=True)]
        for w in fresh:
            if len(w) > SHORT:
                del known[w]
        return out

    def _apart(self, text: str) -> tuple[list[str], int]:
        """The text between strings of special tokens, and how many of those there are."""
        if not any(s in text for s in self.special):
            return [text], 0
        parts = re.split("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), text)
        return parts, len(parts) - 1


def _keep(pick, word, lengths, ids):
    return word[pick], lengths[pick], ids[np.repeat(pick, lengths)]


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(1)
def _patterns():
    import regex

    white = r"\t-\r \x85\xa0  -     　"
    return re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"), regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{white}\p{{L}}\p{{N}}]+")


def pre_tokens(text: str) -> list[str]:
    """The words that are merged, each on its own. White space parts them and is dropped, so runs of it need no rewriting."""
    plain, wide = _patterns()
    if text.isascii():
        return plain.findall(text.lower())
    # case is mapped character by character, without regard to a word's end
    return wide.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


@lru_cache(2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with ``out``: long, the tokens of the whole text. ``vocabulary`` is the path of a tokenizers file that every executor has."""
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.LongType(), False)])

    def run(batches):
        count = merger(vocabulary).count_texts
        for batch in batches:
            for part in slices(batch, text):
                made = pa.array(count(part.column(text).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], [*rest, out])

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, schema)
