"""Benchmark decontamination by a random-walk embedding and bit-sampling LSH.

An item of m words is looked for in all windows of m words.  The embedding of Chakraborty,
Goldenberg and Koucky (2016) walks over a window: at each step it writes down the word it
stands on and moves on by a random bit that hangs on step and word, so that walks over
two windows a few edits apart soon run together again: edit distance becomes Hamming
distance.  Sampling some of the written words gives an LSH key; EMBEDDINGS times
SAMPLINGS keys are tried, and every meeting is verified by the exact edit distance.

Walks start only where they can lead to an item.  k edits leave all but k of any words of
an item in place, so of its k + NEED rarest words (rarest in the benchmark) a window must
hold NEED; windows that don't are passed over without loss.  Words are compared without
case and ASCII punctuation, by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, prepare, slices
from .shingles import U, folded, mix, word_hashes

#: Edits allowed per word of an item, and words of the shortest item that is looked for inside texts; a shorter one counts
#: where it is the whole text.
EDITS, SHORTEST = 0.2, 5
#: Keys per window: embeddings, samplings of each, words in a sampling.  At 20 % edits in 40 words about a
#: third of the written words differ, so a key agrees in 1 of 8 cases.
EMBEDDINGS, SAMPLINGS, SAMPLE = 8, 16, 5
#: Words of an item that a window must hold before it is walked over.
NEED = 5
#: Words and items of the benchmark that are broadcast at once (an item has 128 keys of 16 bytes); larger benchmarks are
#: searched block by block.
BLOCK_WORDS, BLOCK_ITEMS = 2_000_000, 20_000
VOCABULARY_BITS = 20

_rng = np.random.default_rng(5)
_STEP = _rng.integers(0, 1 << 63, (EMBEDDINGS, 1 << 12), dtype=np.uint64) * U(2) + U(1)
_WHERE = _rng.uniform(0, 1, (EMBEDDINGS, SAMPLINGS, SAMPLE))


def edits_allowed(m: int) -> int:
    return int(EDITS * m)


def window_keys(words: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """LSH keys of the windows of m words at ``starts``: one row each, EMBEDDINGS * SAMPLINGS columns."""
    steps = 2 * m
    out = np.empty((len(starts), EMBEDDINGS * SAMPLINGS), dtype=np.uint64)
    for e in range(EMBEDDINGS):
        at = np.zeros(len(starts), dtype=np.int64)
        written = np.empty((steps, len(starts)), dtype=np.uint64)
        for j in range(steps):
            inside = at < m
            word = np.where(inside, words[starts + np.minimum(at, m - 1)], U(0))
            written[j] = word
            at = at + (inside & ((word * _STEP[e, j % _STEP.shape[1]]) >> U(63) == 1))
        places = np.sort((_WHERE[e] * steps).astype(int), axis=1)  # one row per sampling
        key = np.repeat(m * 1000 + e * SAMPLINGS + np.arange(SAMPLINGS, dtype=np.uint64)[:, None], len(starts), axis=1)
        for k in range(SAMPLE):
            key = mix(key * U(0x9E3779B97F4A7C15) + written[places[:, k]])
        out[:, e * SAMPLINGS : (e + 1) * SAMPLINGS] = key.T
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two arrays of words of equal width, all rows at once."""
    n, m = a.shape
    column = np.arange(m + 1)
    row = np.tile(column, (n, 1))
    for i in range(1, m + 1):
        best = np.empty_like(row)
        best[:, 0] = i
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i - 1 : i]))
        row = np.minimum.accumulate(best - column, axis=1) + column
    return row[:, m]


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, ids: list[int], texts: list[str]):
        values, separators = folded()
        words, counts = word_hashes([x.casefold().encode() for x in texts], values, separators)
        ends = np.cumsum(counts)
        keep = [i for i in range(len(texts)) if counts[i] >= SHORTEST]
        self.short: dict[bytes, list[int]] = {}  # items that count as whole texts only, by their words
        for i in range(len(texts)):
            if 0 < counts[i] < SHORTEST:
                self.short.setdefault(words[ends[i] - counts[i] : ends[i]].tobytes(), []).append(ids[i])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in sorted({int(counts[i]) for i in keep}):
            own = [i for i in keep if counts[i] == m]
            starts = np.array([ends[i] - m for i in own])
            keys = window_keys(words, starts, m)
            flat, owner = keys.ravel(), np.repeat(np.arange(len(own)), keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.by_length[m] = flat[order], owner[order], words[starts[:, None] + np.arange(m)], np.array([ids[i] for i in own])
        # Marks: the rarest words of each item, by word the items (as rows of ``sizes`` and ``need``) that it marks.
        spread: dict[int, int] = {}
        for i in keep:
            for w in set(words[ends[i] - counts[i] : ends[i]].tolist()):
                spread[w] = spread.get(w, 0) + 1
        marks = []
        self.sizes = np.array([int(counts[i]) for i in keep], dtype=np.int64)
        self.need = np.empty(len(keep), dtype=np.int64)
        for row, i in enumerate(keep):
            own_words = sorted(words[ends[i] - counts[i] : ends[i]].tolist(), key=lambda w: (spread[w], w))
            chosen = own_words[: edits_allowed(counts[i]) + NEED]
            self.need[row] = max(1, len(chosen) - edits_allowed(counts[i]))
            marks += [(w, row) for w in set(chosen)]
        marks.sort()
        self.marked, first = np.unique(np.array([w for w, _ in marks], dtype=np.uint64), return_index=True)
        self.row = np.array([r for _, r in marks], dtype=np.int64)
        self.first = np.r_[first, len(marks)]
        self.quick = np.zeros(1 << VOCABULARY_BITS, dtype=bool)
        self.quick[(self.marked >> U(64 - VOCABULARY_BITS)).astype(np.int64)] = True
        self.gap = max((edits_allowed(m) for m in self.by_length), default=0) + 1

    def candidates(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each window size, the starts (places, ascending) of windows that hold enough marks of an item."""
        at = np.flatnonzero(self.quick[(words >> U(64 - VOCABULARY_BITS)).astype(np.int64)])
        mark = np.minimum(np.searchsorted(self.marked, words[at]), len(self.marked) - 1)
        same = self.marked[mark] == words[at]
        at, mark = at[same], mark[same]
        n = self.first[mark + 1] - self.first[mark]
        place = np.repeat(at, n)
        row = self.row[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[mark], n)]
        order = np.lexsort((place, row))
        place, row = place[order], row[order]
        last = np.arange(len(row)) + self.need[row] - 1
        ok = last < len(row)
        i, j = np.flatnonzero(ok), last[ok]
        ok = (row[i] == row[j]) & (place[j] - place[i] < self.sizes[row[i]])
        i, j = i[ok], j[ok]
        m = self.sizes[row[i]]
        low, high = np.maximum(place[j] - m + 1, 0), place[i]
        out = {}
        for size in np.unique(m):
            own = m == size
            length = high[own] - low[own] + 1
            starts = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low[own], length)
            out[int(size)] = np.unique(starts)
        return out

    def hits(self, texts: list[bytes]) -> list[dict[int, tuple[int, int]]]:
        """For each text, the items found in it: id -> (edits, number of the window's first word)."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        values, separators = folded()
        plain, counts = word_hashes(texts, values, separators)
        if self.short:
            ends = np.cumsum(counts)
            for k in np.flatnonzero((counts > 0) & (counts < SHORTEST)).tolist():
                found[k].update((i, (0, 0)) for i in self.short.get(plain[ends[k] - counts[k] : ends[k]].tobytes(), ()))
        if not len(self.marked):
            return found
        # Before each text and after the last lies a gap of words that no item has, too wide for a window to bridge.
        owner = np.repeat(np.arange(len(texts)), counts)
        words = np.zeros(len(plain) + self.gap * (len(texts) + 1) + max(self.by_length), dtype=np.uint64)
        places = np.arange(len(plain)) + self.gap * (owner + 1)
        words[places] = plain
        first = np.r_[0, np.cumsum(counts)[:-1]] + self.gap * (np.arange(len(texts)) + 1)
        for m, all_starts in self.candidates(words).items():
            keys, who, rows, ids = self.by_length[m]
            for k in range(0, len(all_starts), 4096):
                starts = all_starts[k : k + 4096]
                own = window_keys(words, starts, m).ravel()
                low = np.searchsorted(keys, own, "left")
                n = np.searchsorted(keys, own, "right") - low
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                n, low = n[some], low[some]
                window = np.repeat(some // (EMBEDDINGS * SAMPLINGS), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                pair = np.unique(window * len(ids) + who[place])
                window, item = pair // len(ids), pair % len(ids)
                for p in range(0, len(pair), 4096):
                    w, i = window[p : p + 4096], item[p : p + 4096]
                    far = edit_distances(words[starts[w][:, None] + np.arange(m)], rows[i])
                    for g in np.flatnonzero(far <= edits_allowed(m)):
                        # A window within the edits has words of one text only: the last that starts before its middle.
                        start = int(starts[w[g]])
                        text = int(np.searchsorted(first, start + m // 2, "right")) - 1
                        own_hit = (int(far[g]), max(start - int(first[text]), 0))
                        item_id = int(ids[i[g]])
                        if item_id not in found[text] or own_hit < found[text][item_id]:
                            found[text][item_id] = own_hit
        return found


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[Items, bool]]:
    """The benchmark block by block, and whether a block is the last."""
    size = items.agg(F.sum(F.octet_length(text)).alias("n"), F.count("*").alias("items")).first()
    n = max(1, -(-(size["n"] or 0) // (4 * BLOCK_WORDS)), -(-size["items"] // BLOCK_ITEMS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64(key, text), F.lit(n)) == k).select(key, text).toArrow().sort_by(key)
        yield Items(rows.column(0).to_pylist(), [x or "" for x in rows.column(1).to_pylist()]), k == n - 1


def found_items(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", into: str = "found") -> DataFrame:
    """All columns of ``docs`` and ``into``: for each item that the text holds, its id, the number of
    ``edits`` in words, and the place (``word``) of the closest window's first word, by id.

    A text holds an item of m words if some window of m words in it is within 0.2 m edits of
    the item; an item of less than five words it holds only if it consists of it.  A text up
    to that much shorter than an item can hold it too.  Null, empty and blank texts hold
    nothing; items without words are passed over; items repeated under several ids are each
    reported.  Every row gives one row, equal rows equal ones.  A column named as ``into`` is
    replaced.  The benchmark is read block by block: a block is bounded (BLOCK_WORDS, BLOCK_ITEMS), each
    block is one pass over the documents, and of several, each pass is written before the
    next block is built.
    """
    docs = docs.drop(into)
    prepare(docs.sparkSession)
    one = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("word", T.LongType())])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("word", pa.int64())]))
    place, width = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(one))])
    out = docs
    for block, last in _blocks(items.where(F.col(item_key).isNotNull()), item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            claim(__name__)
            for batch in batches:
                texts = [(x or "").casefold().encode() for x in batch.column(place).to_pylist()]
                before = batch.column(width).to_pylist() if batch.num_columns > width else [[]] * len(texts)
                found = []
                for a, b in slices([len(x) for x in texts], 2_000_000):
                    for hits in shared.value.hits(texts[a:b]):
                        found.append([{"item_id": i, "edits": e, "word": w} for i, (e, w) in hits.items()])
                found = [sorted(x + y, key=lambda hit: hit["item_id"]) for x, y in zip(before, found)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, kind)], names=schema.names)

        out = out.mapInArrow(run, schema)
        if not last:
            out = cut(out, "found-items")
            shared.destroy()
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item; columns stay as they are, whatever their names."""
    free = next(c for c in (f"found{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    return found_items(docs, items, text, item_key, item_text, free).where(F.size(free) == 0).drop(free)
