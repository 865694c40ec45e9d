"""Token counts by rank-synchronous merging of ragged symbol arrays.

A batch of distinct pre-tokens lies end to end in one numpy array of symbols.
Each round finds, for every pre-token at once, its lowest-ranked adjacent pair
and merges all places of that pair together; finished pre-tokens leave the
array with the number of symbols that survive.  Rounds needed: the longest
pre-token's number of distinct merges.  A pre-token of more than LONG bytes has
an array of its own, whose places are kept by rank: a round takes the places of
the lowest rank there is and looks at their neighbours only, so that the time
grows with the merges and not with rounds times length.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, remembers
from .pretokens import pretoken_lists

NONE = np.int64(1 << 40)
#: Pre-tokens whose counts a Python worker remembers; when full it starts anew.
REMEMBERED = 400_000
TABLE_BITS = 19
#: Longer pre-tokens (bytes) are merged on their own.
LONG = 2000
#: Odd 64-bit factors of the multiplicative hash, one for each table in turn.
MULTIPLIERS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64)) for k in range(64)]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return out


class MergeTable:
    """Pairs and ranks of a byte-level BPE file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = np.full(len(vocab) + len(self.special) + 1, -1, dtype=np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if not (np.maximum(born[left], born[right]) < np.arange(len(made))).all():
            raise ValueError("a merge uses a symbol that only a later merge makes")
        self.keys, self.made = left << 32 | right, made
        # Hash tables from pair to rank, each for the pairs whose slot an earlier one has given away.
        self.tables, rest = [], np.arange(len(made))
        while len(rest):
            factor = MULTIPLIERS[len(self.tables)]
            slot = self.slot(self.keys[rest], factor)
            _, first = np.unique(slot, return_index=True)
            table = np.zeros(1 << TABLE_BITS, dtype=np.int32)
            table[slot[first]] = rest[first]
            self.tables.append((factor, table))
            rest = np.delete(rest, first)

    @staticmethod
    def slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * factor >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no merge."""
        want = left << 32 | right
        out = np.full(len(want), NONE)
        todo = np.arange(len(want))
        for factor, table in self.tables:
            at = table[self.slot(want[todo], factor)]
            same = self.keys[at] == want[todo]
            out[todo[same]] = at[same]
            # A free slot holds rank 0, whose pair differs: such pairs look in the next, smaller set.
            todo = todo[~same]
        return out

    def long_count(self, word: bytes) -> int:
        """Surviving symbols of one long word.

        A merge makes pairs of higher rank only, as each symbol is made before it is used; so ranks come up in rising
        order, and places that a rank has when it comes up are all it will ever have.
        """
        symbols = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n + 1, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(places: np.ndarray) -> None:
            found = self.ranks(symbols[places], symbols[after[places]])
            some = found < NONE
            places, found = places[some], found[some]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            edges = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else found
            for rank, part in zip(found[edges].tolist(), np.split(places, edges[1:])):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks, rank)
                waiting[rank].append(part)

        put(np.arange(n - 1))
        while ranks:
            rank = heapq.heappop(ranks)
            where = np.unique(np.concatenate(waiting.pop(rank)))
            left, right = self.keys[rank] >> 32, self.keys[rank] & 0xFFFFFFFF
            where = where[alive[where] & (symbols[where] == left)]
            where = where[after[where] < n]
            where = where[symbols[after[where]] == right]
            if not len(where):
                continue
            # Where one symbol repeats, pairs overlap: every other one from the left is merged.
            first = np.r_[True, after[where[:-1]] != where[1:]]
            run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            gone = after[where]
            symbols[where] = self.made[rank]
            alive[gone] = False
            after[where] = after[gone]
            inner = after[where] < n
            before[after[where[inner]]] = where[inner]
            put(np.unique(np.r_[where[inner], before[where][before[where] >= 0]]))
        return int(alive[:n].sum())

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        if long := [k for k, w in enumerate(words) if len(w) > LONG]:
            out = np.zeros(len(words), dtype=np.int64)
            out[long] = [self.long_count(words[k]) for k in long]
            short = np.setdiff1d(np.arange(len(words)), long)
            out[short] = self.counts([words[k] for k in short.tolist()])
            return out
        out = np.zeros(len(words), dtype=np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), NONE)
            inner = np.flatnonzero(owner[1:] == owner[:-1])  # the last symbol of a word has no right neighbour
            rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            done = best == NONE
            out[owner[starts[done]]] = sizes[done]
            going = np.repeat(~done, sizes)
            hit = (rank == np.repeat(best, sizes)) & going
            # Where one symbol repeats, pairs overlap: every other one from the left is merged.
            where = np.flatnonzero(hit)
            first = np.r_[True, np.diff(where) != 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbols[where] = self.made[rank[where]]
            going[where + 1] = False
            symbols, owner = symbols[going], owner[going]
        return out


@lru_cache(2)
def _table(path: str) -> tuple[MergeTable, dict[str, int]]:
    return MergeTable(path), {}


remembers(__name__, lambda: _table.cache_clear())


def count_batch(texts: list[str], path: str) -> list[int]:
    """Tokens of each text; strings of special tokens inside a text are one token each."""
    table, known = _table(path)
    out = []
    for text in texts:
        parts, n = [text], 0
        for s in table.special:
            parts = [y for x in parts for y in x.split(s)]
        n += len(parts) - 1
        for part in parts:
            for pieces in pretoken_lists(part):
                if new := list(set(pieces).difference(known)):
                    if len(known) > REMEMBERED:
                        known.clear()
                        new = list(set(pieces))
                    known.update(zip(new, table.counts([w.encode() for w in new]).tolist(), strict=True))
                n += sum(map(known.__getitem__, pieces))
        out.append(n)
    return out


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int = 512) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row.

    A null text counts as the empty one (0 bytes, 0 tokens).  Every input row gives
    one row, equal rows included; other columns are left out.  An empty table gives
    an empty result.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def function(texts: list[str]) -> list:
        n = _grouped_counts(texts, path)
        return [[len(x.encode()) for x in texts], n]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(df, text, keep, fields, function).withColumn("over_limit", F.col("n_tokens") > limit)


def _grouped_counts(texts: list[str], path: str) -> list[int]:
    """As count_batch; the new pre-tokens of all texts in the group are merged in one go."""
    table, known = _table(path)
    short = [i for i, x in enumerate(texts) if len(x) < 200_000 and not any(s in x for s in table.special)]
    lists = {i: next(pretoken_lists(texts[i])) for i in short}
    new = set().union(*lists.values()).difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = set().union(*lists.values())
    words = list(new)
    if words:
        known.update(zip(words, table.counts([w.encode() for w in words]).tolist(), strict=True))
    out = [0] * len(texts)
    for i, pieces in lists.items():
        out[i] = sum(map(known.__getitem__, pieces))
    for i in set(range(len(texts))).difference(lists):
        out[i] = count_batch([texts[i]], path)[0]
    return out
