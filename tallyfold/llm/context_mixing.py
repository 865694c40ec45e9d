"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is a row of tokens (words in lower case, then an end), known by 64-bit hashes.

Successors.  For each pair of tokens in a row the training texts say which token follows
most often, how often, and how often the pair occurs.  This table grows with the corpus:
texts lie in slices; each slice sends its different pairs out once, packed by ranges of
hashes, and gets back what all training texts know of them.  A training row is left out of
what it is told itself.  Where a successor is known, one bit says whether it comes.  A successor is
known by MARK_BITS bits of its hash: the bit says whether a token of that mark comes, and which
of the training tokens with the mark it is costs what its share of them says.

Codes.  Any other token is spelled by a code.  The VOCABULARY most frequent training tokens
fall into CLUSTERS by the very frequent tokens that they tend to follow (signs of language
and subject); a code is that of the cluster, then a Huffman code inside it.  Its first DEPTH
bits are predicted; what follows costs what the token's share of the remaining tokens says.
A token without code is an escape and its bytes, which have Huffman codes by the byte before.
Each bit is predicted in several hashed contexts: for words the place in the code tree alone,
with the token before, and with the last very frequent token; for bytes the place with two,
three and four bytes before; for both, what the text itself has shown at the place so far.

Mixing.  Predictions are mixed in the logistic domain with weights that the kind and depth
of the bit select (the gate); the weights, a table that refines the mixed probability, and
the text's own predictor learn with every bit.  They start from values that were learnt online
from all training rows: these fall into two halves, and each half is mixed against counts of the
other, slice after slice, each slice from what the one before it ended with, the second half from
what the first ended with.  From these values they run through SEGMENT codes,
within which nearly all texts end; a longer text starts again from the learnt values there.
Bits of one code have different gates, so that learning from them one by one or all at once
is the same; only the text's own predictor may share a slot between two of them, and then
learns from the later one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, drop, pack, pack_texts, prepare, release, slices, unpack, unpack_texts
from .shingles import _BYTE, _SPACE, U, mix, word_spans

#: Most tokens with a code of their own, the least count of one (what occurs once is spelled, so that spelling is learnt
#: too), and up to which count a token is spelled besides when contexts are counted.
VOCABULARY, LEAST, SELDOM = 1 << 18, 2, 6
#: Clusters of tokens, the most frequent tokens that clusters go by and that are contexts, and how many bits of a word's
#: code are predicted.
CLUSTERS, CLUSTERS_BY, FREQUENT, DEPTH = 8, 32, 64, 7
#: Slots of each predictor's table, by the number of training tokens (2^most at most: the tables are broadcast).
TABLE_BITS_LEAST, TABLE_BITS_MOST, CHUNK = 19, 20, 1 << 16
PREDICTORS, LOCAL, DOUBT = 3, 512, 0.4
SEGMENT, LANES = 2048, 4000
#: Mixed values lie within MOST and fall into BUCKETS.
RATE, REFINE_RATE, LOCAL_RATE, MOST, BUCKETS = 0.03, 0.02, 0.1, 12, 25
#: Gates: bits of words by depth, of bytes by depth (deep ones share one) and by whether four and three bytes before were
#: met, and of successors by how many came before and how often the pair occurs.
BYTE_DEPTHS, RUNS, SEEN = 20, 5, 3
BYTE_GATES, FLAG_GATES = DEPTH, DEPTH + 3 * BYTE_DEPTHS
GATES = FLAG_GATES + RUNS * SEEN
#: Slots after the tables: levels of a successor's prediction, one that always says 1, one that says nothing.
LEVELS = 64
SLICE_BYTES, RANGE, BITS_AT_ONCE, CLUSTER_CHUNK = 3_000_000, 1_000_000, 100_000, 4096
#: Bits of a successor, and how many more bits the hash of a pair has than the number of tokens.
MARK_BITS, SPARE_BITS = 16, 6
PREFIX_BITS = 18
END = U(0x5851F42D4C957F2D)  # the hash of the end of a text
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_LETTER = np.arange(256)
_LETTER[65:91] += 32
_LETTER[[9, 10, 11, 12, 13, 32]] = 256
_LOWER = _BYTE[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]


class Tokens:
    """Tokens of some texts: ``h``, ``counts`` (with the ends), and where each lies in ``data`` (an end has no bytes)."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        h, starts, ends = word_spans(self.data, _LOWER, _SPACE)
        firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
        words = np.diff(np.searchsorted(starts, firsts))
        self.counts = words + 1
        self.last = np.cumsum(self.counts) - 1
        place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), words)
        n = len(h) + len(texts)
        self.h = np.full(n, END, dtype=np.uint64)
        self.start, self.end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.h[place], self.start[place], self.end[place] = h, starts, ends
        self.first = np.zeros(n, dtype=bool)
        self.first[self.last + 1 - self.counts] = True

    @cached_property
    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """The different hashes in order, and which of them each token has."""
        return np.unique(self.h, return_inverse=True)

    def before(self, values: np.ndarray, none) -> np.ndarray:
        """The value of the token before each, ``none`` at the start of a text."""
        out = np.r_[values[:1], values[:-1]]
        out[self.first] = none
        return out

    def pairs(self, bits: int) -> np.ndarray:
        """For each token a key of ``bits`` bits for the two before it, then MARK_BITS bits of its own."""
        one = self.before(self.h, U(0))
        pair = mix(one * _M[0] + self.before(one, U(0)) * _M[1] + U(1))
        return pair >> U(64 - bits) << U(MARK_BITS) | mark_of(self.h)


def mark_of(h: np.ndarray) -> np.ndarray:
    """The bits that a successor is known by."""
    return mix(h * _M[2]) >> U(64 - MARK_BITS)


# --- what slices tell and learn ------------------------------------------------------------------

def text_slices(own: DataFrame) -> DataFrame:
    """``slice, dev, keys, held, sizes, texts``: the rows (``key, text, held_out, dev``) in slices of about SLICE_BYTES;
    rows of each ``dev`` (null is one too) have slices of their own, whose numbers leave 0, 1 (true) or 2 (null) modulo 4."""
    fields = {f.name: f.dataType for f in own.schema.fields}
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("dev", T.BooleanType()), T.StructField("keys", T.ArrayType(fields["key"])),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType()),
    ])

    def run(batches):
        claim(__name__)
        number, waiting = TaskContext.get().partitionId() << 32, {dev: ([], [], []) for dev in (True, False, None)}
        kind = None

        def out(dev):
            nonlocal number
            keys, held, texts = waiting[dev]
            waiting[dev] = ([], [], [])
            number += 4
            return pa.RecordBatch.from_arrays([
                pa.array([number + (2 if dev is None else dev)], pa.int64()), pa.array([dev], pa.bool_()), pa.array([keys], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([pack_texts(texts)], pa.binary()),
            ], names=schema.names)

        sizes = dict.fromkeys(waiting, 0)
        for batch in batches:
            kind = batch.column(0).type
            for key, text, held, dev in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                for to, x in zip(waiting[dev], (key, held, (text or "").encode())):
                    to.append(x)
                sizes[dev] += len(text or "") + 8
                if sizes[dev] > SLICE_BYTES:
                    sizes[dev] = 0
                    yield out(dev)
        yield from (out(dev) for dev in waiting if waiting[dev][0])

    return cut(own.select("key", "text", "held_out", "dev").mapInArrow(run, schema), "slices")


@dataclass
class Layout:
    """How keys are dealt: bits of a pair's hash, and bits of a token's and of a pair's key that name its range."""

    pair_bits: int
    token_range: int
    pair_range: int

    @classmethod
    def of(cls, size: int) -> Layout:
        tokens = max(1, size // 6)
        ranges = max(0, math.ceil(math.log2(max(1, tokens / RANGE))))
        return cls(min(64 - MARK_BITS, max(24, math.ceil(math.log2(tokens + 1)) + SPARE_BITS)), max(0, ranges - 2), ranges)

    def ranges(self, keys: np.ndarray, kind: int) -> np.ndarray:
        bits, n = (self.token_range, 64) if kind == 0 else (self.pair_range, self.pair_bits + MARK_BITS)
        return (keys >> U(n - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def answers(sliced: DataFrame, layout: Layout) -> DataFrame:
    """What all training texts know of each slice's tokens and pairs: ``slice, range, data``, in the order in which the
    slice sent them.  An even range has the tokens' counts, an odd one for each pair its most frequent successor, how often
    that came, and how often the pair.  Rows with slice -1 have the range's frequent tokens, in ``n`` and ``v`` the sums
    of its tokens' counts and how many there are, and in ``data`` the counts by mark."""

    def dealt(batches):
        claim(__name__)
        for batch in batches:
            for number, held, sizes, texts in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                t = Tokens(unpack_texts(sizes, texts))
                train = np.repeat(~np.array(held, dtype=bool), t.counts)
                for kind, keys in ((0, t.h), (1, t.pairs(layout.pair_bits))):
                    # Sorting values is much faster than sorting places, which `return_inverse` would do.
                    taught, times = np.unique(keys[train], return_counts=True)
                    keys = np.sort(keys)
                    keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
                    n = np.zeros(len(keys), dtype="<u4")
                    n[np.searchsorted(keys, taught)] = times
                    ranges, first = np.unique(layout.ranges(keys, kind), return_index=True)
                    edges = [*first.tolist(), len(keys)]
                    parts = [(pack(np.diff(keys[a:b], prepend=U(0))), pack(n[a:b])) for a, b in zip(edges, edges[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number] * len(parts), pa.int64()), pa.array(ranges * 2 + kind, pa.int64()), pa.array([p for p, _ in parts], pa.binary()), pa.array([p for _, p in parts], pa.binary()),
                    ], names=["slice", "range", "keys", "counts"])

    def known(table: pa.Table) -> pa.Table:
        each = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.float64)
        keys, at = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        ids, kind = table.column("slice").to_pylist(), table.column("range")[0].as_py()
        if kind % 2 == 0:
            found = np.minimum(total, 2**63 - 1)[at]
            data = [pack(x) for x in np.split(found, np.cumsum([len(x) for x in each])[:-1])]
            marked = pack(np.bincount(mark_of(keys).astype(np.int64), weights=total, minlength=1 << MARK_BITS).astype(np.int64))
            some = np.flatnonzero(total >= LEAST)
            if len(some) > VOCABULARY:
                some = some[np.lexsort((keys[some], -total[some]))[:VOCABULARY]]
            frequent, n, v = [keys[some].view(np.int64).tolist(), total[some].tolist()], int(total.sum()), int((total > 0).sum())
        else:
            pairs = keys >> U(MARK_BITS)
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, dtype=np.int64)
            most = np.minimum(total, 2**40).astype(np.uint64) << U(MARK_BITS) | (~keys & U((1 << MARK_BITS) - 1))
            best, seen = np.maximum.reduceat(most, first), np.add.reduceat(total, first)
            of = np.zeros(len(keys), dtype=np.int64)
            of[first[1:]] = 1
            of = np.cumsum(of)[at]
            data = []
            for p in np.split(of, np.cumsum([len(x) for x in each])[:-1]):
                p = p[np.r_[True, p[1:] != p[:-1]]]
                said = seen[p] > 1  # what occurs once is known to its own text only, or to none
                times = np.where(said, (best[p] >> U(MARK_BITS)).astype(np.int64), 0)
                mark = np.where(said, (~best[p] & U((1 << MARK_BITS) - 1)).astype(np.int64), 0)
                data.append(_joined(mark, times, np.where(said, seen[p], 0)))
            frequent, n, v, marked = [[], []], 0, 0, None
        k = len(ids)
        return pa.table({
            "slice": pa.array([*ids, -1], pa.int64()), "range": pa.array([kind] * (k + 1), pa.int64()), "data": pa.array([*data, marked], pa.binary()),
            "hashes": pa.array([None] * k + [frequent[0]], pa.list_(pa.int64())), "counts": pa.array([None] * k + [frequent[1]], pa.list_(pa.int64())),
            "n": pa.array([None] * k + [n], pa.int64()), "v": pa.array([None] * k + [v], pa.int64()),
        })

    packed = sliced.select("slice", "held", "sizes", "texts").mapInArrow(dealt, "slice long, range long, keys binary, counts binary")
    kind = "slice long, range long, data binary, hashes array<long>, counts array<long>, n long, v long"
    return cut(packed.groupBy("range").applyInArrow(known, kind), "answers")


def _joined(mark: np.ndarray, times: np.ndarray, seen: np.ndarray) -> bytes:
    rows = np.zeros(len(mark), dtype=[("mark", "<u2"), ("times", "<u4"), ("seen", "<u4")])
    rows["mark"], rows["times"], rows["seen"] = mark, np.minimum(times, 2**32 - 1), np.minimum(seen, 2**32 - 1)
    return pack(rows)


_ANSWER = np.dtype([("mark", "<u2"), ("times", "<u4"), ("seen", "<u4")])


def answered(sliced: DataFrame, known: DataFrame) -> DataFrame:
    """Slices with ``found``, their answers by range."""
    each = known.where("slice >= 0").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("range", "data"))).alias("found"))
    return sliced.join(each, "slice").select("keys", "held", "sizes", "texts", "found")


def answered_parts(sliced: DataFrame, known: DataFrame) -> list[DataFrame]:
    """:func:`answered` for the slices of each half and for those held out, written one part after the other: an answer is
    shuffled once, and a part's shuffle files go before those of the next come."""
    parts = []
    for k in range(3):
        own = F.pmod("slice", F.lit(4)) == k
        parts.append(cut(answered(sliced.where(own), known.where((F.col("slice") >= 0) & own)), "answered"))
        release(sliced.sparkSession)
    return parts


def known_counts(t: Tokens, found: list[dict]) -> np.ndarray:
    """How often training texts have each token."""
    _, of = t.different
    return np.concatenate([unpack(x["data"], np.int64) for x in found if x["range"] % 2 == 0])[of]


def marked_counts(about: DataFrame) -> np.ndarray:
    """How many training tokens have each mark, from the rows of the ranges."""

    def added(batches):
        total = np.zeros(1 << MARK_BITS, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += unpack(data, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["mark", "n"])

    rows = about.where("data IS NOT NULL").select("data").mapInArrow(added, "mark int, n long").groupBy("mark").agg(F.sum("n").alias("n")).collect()
    out = np.ones(1 << MARK_BITS, dtype=np.int64)
    for r in rows:
        out[r["mark"]] = max(1, r["n"])
    return out


def told(t: Tokens, held: list[bool], found: list[dict], layout: Layout, counts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`successors`, where only a token that training texts have can be one, and what it costs (a natural logarithm) to
    say which token of its mark it is."""
    times, seen, hit = successors(t, held, found, layout)
    hit &= counts > 0
    which = np.zeros(len(hit))
    which[hit] = np.log(counts[hit] / marks[mark_of(t.h[hit]).astype(np.int64)])
    return times, seen, hit, which


def successors(t: Tokens, held: list[bool], found: list[dict], layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: how often the successor that is known for the two before it came (0: none is known), how often the
    pair occurred, and whether the token has its mark; each training text is left out of its own numbers."""
    keys = t.pairs(layout.pair_bits)
    pair, mark = keys >> U(MARK_BITS), (keys & U((1 << MARK_BITS) - 1)).astype(np.uint16)
    different, of = np.unique(pair, return_inverse=True)
    rows = np.concatenate([unpack(x["data"], _ANSWER) for x in found if x["range"] % 2])
    assert len(rows) == len(different)
    rows = rows[of]
    times, seen, hit = rows["times"].astype(np.int64), rows["seen"].astype(np.int64), rows["mark"] == mark
    some = np.flatnonzero((times > 0) & np.repeat(~np.array(held, dtype=bool), t.counts))
    owner = np.repeat(np.arange(len(t.counts)), t.counts)[some].astype(np.uint64)
    own, of = np.unique(owner * U(len(different)) + of[some].astype(np.uint64), return_inverse=True)
    mine = np.bincount(of, minlength=len(own))[of]
    mine_hit = np.bincount(of, weights=hit[some], minlength=len(own))[of].astype(np.int64)
    times[some] -= mine_hit
    seen[some] -= mine
    times[times < 1] = 0
    return times, seen, hit & (times > 0)


# --- codes ---------------------------------------------------------------------------------------

def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's code starts, its length, and for all codes end to end the inner nodes (the root is the last) and
    the bits on the way from the root.  Counts are raised to a billionth of all, which bounds the lengths."""
    n = len(counts)
    counts = np.maximum(counts.astype(np.int64), max(1, int(counts.sum()) >> 30))
    order = np.argsort(counts, kind="stable")
    leaf, inner = counts[order].tolist(), []
    parent, side = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.uint8)
    i = j = 0
    for node in range(n, 2 * n - 1):
        total = 0
        for bit in (0, 1):
            if j >= len(inner) or i < n and leaf[i] <= inner[j]:
                x, total, i = i, total + leaf[i], i + 1
            else:
                x, total, j = n + j, total + inner[j], j + 1
            parent[x], side[x] = node, bit
        inner.append(total)
    # Lengths: one step up at a time for all symbols.
    at = np.empty(n, dtype=np.int64)
    at[order] = np.arange(n)
    length, up, root = np.zeros(n, dtype=np.int64), at.copy(), 2 * n - 2
    while (below := up != root).any():
        length += below
        up[below] = parent[up[below]]
    start = np.cumsum(length) - length
    node, bits = np.empty(int(length.sum()), dtype=np.int64), np.empty(int(length.sum()), dtype=np.uint8)
    symbol = np.arange(n)
    for k in range(int(length.max(initial=0))):
        symbol = symbol[length[symbol] > k]
        place = start[symbol] + length[symbol] - 1 - k
        node[place], bits[place] = parent[at[symbol]] - n, side[at[symbol]]
        at[symbol] = parent[at[symbol]]
    return start, length, node, bits


class Vocabulary:
    """Tokens with a code, by falling count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.ids = np.argsort(hashes)
        self.hashes, self.n, self.counts = hashes[self.ids], len(hashes), counts
        # Where the hashes begin that share their first PREFIX_BITS.
        self.first = np.searchsorted(self.hashes >> U(64 - PREFIX_BITS), np.arange((1 << PREFIX_BITS) + 1, dtype=np.uint64)).astype(np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Numbers of tokens; ``n`` for those without a code."""
        prefix = (h >> U(64 - PREFIX_BITS)).astype(np.int64)
        at, end, out = self.first[prefix], self.first[prefix + 1], np.full(len(h), self.n)
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            same = self.hashes[place] == h[left]
            out[left[same]] = self.ids[place[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def topics(t: Tokens, ids: np.ndarray, frequent: int) -> np.ndarray:
    """For each token the number of the last very frequent token before it in the text, ``frequent`` if there is none."""
    often = np.where(ids < frequent, np.arange(len(ids)), -1)
    last = np.r_[-1, np.maximum.accumulate(often)[:-1]]
    return np.where(last >= np.repeat(t.last + 1 - t.counts, t.counts), ids[np.maximum(last, 0)], frequent)


@dataclass
class Codes:
    """Codes of vocabulary tokens, the escape, bytes and ends of spelled tokens (257 for each byte before and for none), and
    the bit of a successor, in one numbering."""

    words: Vocabulary
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    tail: np.ndarray  # natural log of what a word's bits leave open
    table_bits: int
    seldom: int  # the first number of a token with SELDOM occurrences or fewer

    def __post_init__(self):
        self.step = self.node.astype(np.int32) << 1 | self.bit  # looked up together

    @property
    def escape(self) -> int:
        return self.words.n

    @property
    def flag(self) -> int:
        return len(self.length) - 1

    @classmethod
    def build(cls, words: Vocabulary, cluster: np.ndarray, escapes: int, letters: np.ndarray, tokens: int) -> Codes:
        """``cluster`` of each token; ``letters``: counts of bytes (256: the end) by the byte before (256: none)."""
        n, width = words.n, DEPTH + 1
        counts = np.r_[words.counts, max(escapes, 1)].astype(np.int64)
        cluster = np.r_[cluster, CLUSTERS].astype(np.int64)
        node, bit, length = np.full((n + 1, width), -1), np.zeros((n + 1, width), dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
        there = np.unique(cluster)
        top = huffman(np.bincount(cluster, weights=counts)[there])
        nodes = len(there)
        for k, c in enumerate(there):
            own = np.flatnonzero(cluster == c)
            a, b = int(top[0][k]), int(top[1][k])
            length[own] = b
            node[own, :b], bit[own, :b] = top[2][a : a + b], top[3][a : a + b]
            first, size, inner, side = huffman(counts[own])
            for j in range(width - b):
                some = np.flatnonzero(size > j)
                node[own[some], b + j], bit[own[some], b + j] = inner[first[some] + j] + nodes, side[first[some] + j]
            length[own] += size
            nodes += len(own)
        tail = np.zeros(n + 1)
        open_ = np.flatnonzero(length > DEPTH)
        left = node[open_, DEPTH]  # the tree that remains
        tail[open_] = np.log(counts[open_]) - np.log(np.bincount(left, weights=counts[open_])[left] if len(left) else 1)
        length = np.minimum(length, DEPTH)
        kept = np.arange(width) < length[:, None]
        made = [huffman(row) for row in letters]
        lengths = [length, *[m[1] for m in made], np.ones(1, dtype=np.int64)]
        all_nodes = [node[kept], *[m[2] + nodes + 256 * k for k, m in enumerate(made)], np.zeros(1, dtype=np.int64)]
        all_bits = [bit[kept], *[m[3] for m in made], np.zeros(1, dtype=np.uint8)]
        sizes = np.concatenate(lengths)
        bits = min(TABLE_BITS_MOST, max(TABLE_BITS_LEAST, math.ceil(math.log2(tokens + 1))))
        return cls(
            words, np.cumsum(sizes) - sizes, sizes, np.concatenate(all_nodes).astype(np.int32), np.concatenate(all_bits), tail,
            max(bits, (nodes + 256 * 257).bit_length()), int((words.counts > SELDOM).sum()),
        )

    @property
    def slots(self) -> int:
        return PREDICTORS << self.table_bits


class Events:
    """Codes of some texts in order: their symbols and contexts, and how many each text has.  For learning, the seldom tokens
    of the vocabulary (numbers from ``spelled_from``) are spelled besides: new words look like them."""

    def __init__(self, codes: Codes, t: Tokens, found: tuple | None = None, spelled_from: int | None = None):
        esc, n = codes.escape, len(t.h)
        self.codes, ids = codes, codes.words.lookup(t.different[0])[t.different[1]] if found else codes.words.lookup(t.h)
        times, seen, hit, *more = found or (np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool))
        which = more[0] if more else np.zeros(n)
        asked = times > 0
        rare = np.flatnonzero((ids >= (esc if spelled_from is None else spelled_from)) & ~hit)
        sizes = t.end[rare] - t.start[rare] + 1
        events = asked.astype(np.int64) + ~hit
        events[rare] += sizes
        at = np.cumsum(events) - events
        total = int(events.sum())
        self.symbol, self.bit, self.gate = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.uint8), np.zeros(total, dtype=np.uint8)
        self.contexts = np.zeros((PREDICTORS, total), dtype=np.uint32)
        begin = np.repeat(t.last + 1 - t.counts, t.counts)
        place, spelled = at + asked, np.flatnonzero(~hit)
        self.symbol[place[spelled]] = ids[spelled]
        for k, c in enumerate((t.before(ids, esc + 1), topics(t, ids, FREQUENT)), 1):
            self.contexts[k, place[spelled]] = self._mixed(c[spelled].astype(np.uint64), k)
        self.tails = np.add.reduceat(np.where(hit, which, codes.tail[ids]), t.last + 1 - t.counts) if n else np.zeros(0)
        if asked.any():
            missed = np.where(hit, -1, np.arange(n))
            run = np.arange(n) - np.maximum(np.r_[-1, np.maximum.accumulate(missed)[:-1]], begin - 1) - 1
            gate = np.searchsorted([1, 2, 4, 16], run, "right") * SEEN + np.searchsorted([2, 4], seen, "right")
            p = (times[asked] + 0.4) / (np.maximum(seen, times)[asked] + 0.8)
            level = np.clip(np.rint((np.log(p / (1 - p)) + 8) * (LEVELS - 1) / 16), 0, LEVELS - 1).astype(np.uint64)
            a = at[asked]
            self.symbol[a], self.bit[a], self.gate[a], self.contexts[1, a] = codes.flag, hit[asked], gate[asked], level
        if len(rare):
            ends = np.cumsum(sizes)
            inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            data = t.data[np.minimum(np.repeat(t.start[rare], sizes) + inside, len(t.data) - 1)].astype(np.int64)
            data += 32 * ((data >= 65) & (data <= 90))
            data[ends - 1] = 256
            back = [np.where(inside >= k, np.r_[np.zeros(k, dtype=np.int64), data[:-k]][: len(data)], 256) for k in (1, 2, 3, 4)]
            where = np.repeat(place[rare] + 1, sizes) + inside
            self.symbol[where] = esc + 1 + 257 * back[0] + data
            two = back[0] << 9 | back[1]
            three = two << 9 | back[2]
            for k, c in enumerate((three << 9 | back[3], two, three)):
                self.contexts[k, where] = self._mixed(c.astype(np.uint64), k)
        self.per_text = np.add.reduceat(events, t.last + 1 - t.counts) if n else np.zeros(0, dtype=np.int64)

    @staticmethod
    def _mixed(c: np.ndarray, k: int) -> np.ndarray:
        c = (c + U(1)) * _M[2]
        return ((c ^ (c >> U(29))) * _M[1] + U(k << 32) >> U(32)).astype(np.uint32)

    def bits(self, chosen: np.ndarray, counting: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray]:
        """All bits of the chosen codes in order: slots (one row per predictor), places in the text's own predictor, gates
        (the last two not for ``counting``), bits; and of which code each is."""
        codes, symbol = self.codes, self.symbol[chosen]
        n, width, esc = codes.length[symbol], codes.table_bits, codes.escape
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(n)), n)  # looked up by in place of further repetitions, which take longer
        every = np.arange(len(of))
        place = (codes.start[symbol] - first).take(of, mode="clip")
        place += every
        step = codes.step.take(place, mode="clip")
        node, bit = step >> 1, (step & 1).astype(np.uint8)
        slots = np.empty((PREDICTORS, len(node)), dtype=np.int64)
        hashed = node.astype(np.uint32)
        hashed += np.uint32(1)
        hashed *= np.uint32(0x9E3779B1)
        for p in range(PREDICTORS):
            slot = self.contexts[p].take(chosen, mode="clip").take(of, mode="clip")
            slot ^= hashed
            slot *= np.uint32(0x85EBCA6B)
            slot ^= slot >> np.uint32(15)
            slot *= np.uint32(0xC2B2AE35)
            slot >>= np.uint32(32 - width)
            slot += np.uint32(p << width)
            slots[p] = slot
        spelled = (symbol > esc).take(of, mode="clip")
        np.copyto(slots[0], node, where=~spelled)  # few enough for a slot each
        if counting:
            return slots, None, None, bit, of
        gate = every
        gate -= first.take(of, mode="clip")  # the depth
        letters = np.flatnonzero(spelled)
        gate[letters] = BYTE_GATES + 3 * np.minimum(gate[letters], BYTE_DEPTHS - 1)
        local = (hashed >> np.uint32(12)).astype(np.int64) & (LOCAL - 1)
        flags = np.flatnonzero(symbol == codes.flag)
        if len(flags):
            b, own = first[flags], self.gate[chosen[flags]].astype(np.int64)
            bit[b], gate[b], local[b] = self.bit[chosen[flags]], FLAG_GATES + own, LOCAL + own
            slots[:, b] = codes.slots + LEVELS + 1
            slots[0, b] = codes.slots + self.contexts[1][chosen[flags]].astype(np.int64)
            slots[1, b] = codes.slots + LEVELS
        return slots, local, gate, bit, of


# --- mixing --------------------------------------------------------------------------------------

@dataclass
class Mixer:
    """Values that every text starts from."""

    weights: np.ndarray  # gates x (predictors and the text's own)
    refine: np.ndarray  # gates x buckets

    @classmethod
    def fresh(cls) -> Mixer:
        middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2)))
        return cls(np.full((GATES, PREDICTORS + 1), 0.3, dtype=np.float32), np.tile(middle, (GATES, 1)).astype(np.float32))

    @classmethod
    def of(cls, values: np.ndarray) -> Mixer:
        """From the weights and the refinement end to end."""
        edge = GATES * (PREDICTORS + 1)
        return cls(values[:edge].reshape(GATES, -1).astype(np.float32), values[edge:].reshape(GATES, BUCKETS).astype(np.float32))


class Lanes:
    """Texts that are mixed side by side, each with weights, refinement and a predictor of its own."""

    def __init__(self, mixer: Mixer, lanes: int):
        self.n = lanes
        self.w = np.tile(mixer.weights, (lanes, 1))
        self.t = np.tile(mixer.refine.ravel(), lanes)
        self.own = np.zeros(lanes * (LOCAL + RUNS * SEEN), dtype=np.float32)

    def run(self, inputs: np.ndarray, lane: np.ndarray, local: np.ndarray, gate: np.ndarray, bit: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Natural-log probabilities of bits that lie step by step (``steps``: their edges), a step holding at most one bit
        of each lane and gate.  The last column of ``inputs`` is filled in here."""
        w, t, own = self.w, self.t, self.own
        rows = w.view(np.complex128).ravel()  # the weights of a gate as one value of 16 bytes, which is moved faster
        at_all, local_all, y_all = lane * GATES + gate, lane * (LOCAL + RUNS * SEEN) + local, bit.astype(np.float32)
        p_out, cell_all = np.empty(len(bit), dtype=np.float32), at_all * BUCKETS + BUCKETS // 2
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            s, at, y, mine = inputs[a:b], at_all[a:b], y_all[a:b], local_all[a:b]
            said = own.take(mine, mode="clip")
            s[:, -1] = said
            weights = rows.take(at, mode="clip").view(np.float32).reshape(-1, PREDICTORS + 1)
            dot = np.einsum("lp,lp->l", weights, s)
            np.minimum(np.maximum(dot, -MOST, out=dot), MOST, out=dot)
            p = 1 / (1 + np.exp(-dot))
            off = y - p
            off *= np.float32(RATE)
            s *= off.repeat(PREDICTORS + 1).reshape(s.shape)  # faster than rows of four by one
            weights += s
            rows[at] = weights.view(np.complex128).ravel()
            own[mine] = said + (y - 1 / (1 + np.exp(-said))) * np.float32(LOCAL_RATE)
            cell = cell_all[a:b] + np.rint(dot).astype(np.int64)
            r = t.take(cell, mode="clip")
            t[cell] = r + (y - r) * np.float32(REFINE_RATE)
            p_out[a:b] = (p + r) / 2
        p_out = np.clip(p_out, 1e-6, 1 - 1e-6)
        return np.log(np.where(bit == 1, p_out, 1 - p_out))

    def sums(self) -> np.ndarray:
        return np.r_[
            self.w.reshape(self.n, -1).sum(axis=0, dtype=np.float64), self.t.reshape(self.n, -1).sum(axis=0, dtype=np.float64)
        ]


def mixed(events: Events, table: np.ndarray, mixer: Mixer, learned: list | None = None) -> np.ndarray:
    """log10 probability of each text.  ``learned`` collects the sums of what lanes end with, and their number."""
    per_text = events.per_text
    # Segments: (text, first code, number of codes), longest first so that lanes end together.
    ends = np.cumsum(per_text)
    n_seg = -(-per_text // SEGMENT)
    owner = np.repeat(np.arange(len(per_text)), n_seg)
    first = np.repeat(ends - per_text, n_seg) + (np.arange(n_seg.sum()) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)) * SEGMENT
    size = np.minimum(SEGMENT, ends[owner] - first)
    order = np.argsort(-size, kind="stable")
    out = np.zeros(len(per_text))
    for k in range(0, len(order), LANES):
        block = order[k : k + LANES]
        width, lanes = size[block], Lanes(mixer, len(block))
        reach = np.searchsorted(-width, -np.arange(1, int(width[0]) + 1), "right")  # lanes that reach each step
        edges = np.r_[0, np.cumsum(reach)]
        lane = np.arange(edges[-1]) - np.repeat(edges[:-1], reach)
        code = first[block[lane]] + np.repeat(np.arange(len(reach)), reach)
        bits = np.cumsum(np.r_[0, events.codes.length[events.symbol[code]]])
        a, each = 0, np.zeros(len(block))
        while a < len(reach):
            b = max(a + 1, int(np.searchsorted(bits[edges], bits[edges[a]] + BITS_AT_ONCE, "right")) - 1)
            low, high = edges[a], edges[b]
            slots, local, gate, bit, of = events.bits(code[low:high])
            inputs = np.empty((len(bit), PREDICTORS + 1), dtype=np.float32)
            for p in range(PREDICTORS):
                inputs[:, p] = table.take(slots[p], mode="clip")
            letters = np.flatnonzero((gate >= BYTE_GATES) & (gate < FLAG_GATES))
            met = inputs[letters] != 0
            gate[letters] += met[:, 0] + met[:, 2].astype(np.int64)
            where = lane[low:high].take(of, mode="clip")
            logs = lanes.run(inputs, where, local, gate, bit, bits[edges[a : b + 1]] - bits[low])
            each += np.bincount(where, weights=logs, minlength=len(each))
            a = b
        out += np.bincount(owner[block], weights=each, minlength=len(out))
        if learned is not None:
            learned.append((lanes.sums(), len(block)))
    return (out + events.tails) / np.log(10)


# --- gathering -----------------------------------------------------------------------------------

def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


_COUNT = np.dtype([("step", "<u4"), ("n", "<u4")])
_CHUNK_ROW = "chunk int, size int, counts binary"


def _chunks(items):
    """Numbered arrays of counts as rows that hold their numbers other than 0."""
    for c, counts in items:
        some = np.flatnonzero(counts)
        rows = np.zeros(len(some), dtype=_COUNT)
        rows["step"], rows["n"] = np.diff(some, prepend=0), np.minimum(counts[some], 2**32 - 1)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([len(counts)], pa.int32()), pa.array([pack(rows)], pa.binary())], names=["chunk", "size", "counts"])


def _summed(batches) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, size, data in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            rows = unpack(data, _COUNT)
            into = total.setdefault(c, np.zeros(size, dtype=np.int64))
            into[np.cumsum(rows["step"], dtype=np.int64)] += rows["n"]
    return total


def _trained(held: list[bool], sizes: list[int], texts: bytes) -> list[bytes]:
    return [x for x, out in zip(unpack_texts(sizes, texts), held) if not out]


def context_counts(sliced: DataFrame, codes) -> DataFrame:
    """``chunk, counts``: counts of zeros and ones in each slot over all training rows of the slices, a few rows to be added
    per chunk."""

    def counted(batches):
        claim(__name__)
        book = codes.value
        width = book.table_bits
        counts = np.zeros((PREDICTORS, 2 << width), dtype=np.uint32)
        for batch in batches:
            for held, sizes, packed in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                texts = _trained(held, sizes, packed)
                for a, b in slices([len(x) for x in texts], SLICE_BYTES // 4):
                    events = Events(book, Tokens(texts[a:b]), None, book.seldom)
                    done = np.cumsum(book.length[events.symbol])
                    edges = np.r_[0, np.searchsorted(done, np.arange(BITS_AT_ONCE, (done[-1] if len(done) else 0) + BITS_AT_ONCE, BITS_AT_ONCE), "right")]
                    edges[-1] = len(done)
                    for low, high in zip(edges[:-1], edges[1:]):
                        slots, _, _, bit, _ = events.bits(np.arange(low, high), counting=True)
                        for p in range(PREDICTORS):
                            at = slots[p]
                            at -= p << width
                            at <<= 1
                            at += bit
                            np.add.at(counts[p], at, np.uint32(1))
        flat = counts.reshape(-1)
        yield from _chunks((c, flat[c * 2 * CHUNK : (c + 1) * 2 * CHUNK]) for c in range(book.slots // CHUNK))

    def merged(batches):
        yield from _chunks(_summed(batches).items())

    made = sliced.select("held", "sizes", "texts").mapInArrow(counted, _CHUNK_ROW).withColumn("part", F.spark_partition_id() % 16)
    return made.repartition("chunk", "part").drop("part").mapInArrow(merged, _CHUNK_ROW)


def context_table(counts: DataFrame, codes: Codes) -> np.ndarray:
    """Logistic prediction of each slot from the sums of its counts, then the fixed slots of successors.

    What is gathered is one number per slot, PREDICTORS * 2^TABLE_BITS_MOST at most.
    """
    table_bits = codes.table_bits

    def predicted(batches):
        for c, counts in _summed(batches).items():
            n = counts.reshape(-1, 2)
            seen = n.sum(axis=1)
            prediction = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4))
            if c >= (1 << table_bits) // CHUNK:  # what a context has seen seldom counts for less; the first predictor has none
                prediction *= seen / (seen + DOUBT)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([prediction.astype("<f2").tobytes()], pa.binary())], names=["chunk", "counts"])

    found = counts.repartition("chunk").mapInArrow(predicted, "chunk int, counts binary").toArrow()
    table = np.zeros(codes.slots + LEVELS + 2, dtype=np.float32)
    for c, data in zip(found.column(0).to_pylist(), found.column(1)):
        table[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(data.as_buffer(), dtype="<f2")
    table[codes.slots : codes.slots + LEVELS] = np.arange(LEVELS) * 16 / (LEVELS - 1) - 8
    table[codes.slots + LEVELS] = 1
    return table


def fit_mixer(rows: DataFrame, codes, table, layout: Layout, marks: np.ndarray, mixer: Mixer) -> Mixer:
    """What ``mixer`` has become after all texts of the rows (training slices with their answers).  Each task learns online: a
    slice starts from the means of what the texts of the slice before it ended with.  The tasks' last values are averaged, each
    by its number of texts."""
    edge = GATES * (PREDICTORS + 1)
    start = rows.sparkSession.sparkContext.broadcast(mixer)

    def run(batches):
        claim(__name__)
        lanes, now = 0, start.value
        for batch in batches:
            for held, sizes, packed, found in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                t, learned = Tokens(unpack_texts(sizes, packed)), []
                events = Events(codes.value, t, told(t, held, found, layout, known_counts(t, found), marks))
                del t, found  # mixing needs the memory
                mixed(events, table.value, now, learned)
                n = sum(k for _, k in learned)
                now = Mixer.of(sum(x for x, _ in learned) / n)
                lanes += n
        sums = np.r_[now.weights.ravel(), now.refine.ravel()].astype(np.float64) * lanes
        yield pa.RecordBatch.from_arrays([pa.array([lanes], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["lanes", "sums"])

    each = rows.select("held", "sizes", "texts", "found").mapInArrow(run, "lanes long, sums array<double>").where("lanes > 0")
    means = each.select("lanes", F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("lanes").alias("n")).toArrow()
    start.unpersist()
    if not means.num_rows:
        return mixer
    mean = np.zeros(edge + GATES * BUCKETS)
    mean[means.column("k").to_numpy()] = means.column("x").to_numpy() / means.column("n").to_numpy()
    return Mixer.of(mean)


def letter_counts(sliced: DataFrame) -> np.ndarray:
    """How often tokens of training texts have each byte (256: the end) after each (256: none); at least once each."""

    def counted(batches):
        n = np.zeros(257 * 257, dtype=np.int64)
        for batch in batches:
            for held, sizes, packed in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                data = np.frombuffer(b" ".join([b"", *_trained(held, sizes, packed), b""]), dtype=np.uint8)
                codes = _LETTER[data]
                n += np.bincount(codes[:-1] * 257 + codes[1:], minlength=257 * 257)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["b", "n"])

    rows = sliced.select("held", "sizes", "texts").mapInArrow(counted, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.ones(257 * 257, dtype=np.int64)
    if rows.num_rows:
        out[rows.column("b").to_numpy()] += rows.column("n").to_numpy()
    out[-1] = 1  # two blanks
    return out.reshape(257, 257)


def clusters(sliced: DataFrame, words) -> np.ndarray:
    """A cluster for each token of the vocabulary: the very frequent tokens, of which there are CLUSTERS_BY, are put together
    by those that they follow (mixtures of counts, hard assignments), and every other token goes where it fits best."""
    size, wide = words.value.n, CLUSTERS_BY + 1

    def counted(batches):
        claim(__name__)
        counts = np.zeros((words.value.n + 1) * wide, dtype=np.uint32)
        for batch in batches:
            for held, sizes, packed in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if texts := _trained(held, sizes, packed):
                    t = Tokens(texts)
                    ids = words.value.lookup(t.h)
                    np.add.at(counts, ids * wide + topics(t, ids, CLUSTERS_BY), np.uint32(1))
        counts = counts[:-wide]
        yield from _chunks((c, counts[c * CLUSTER_CHUNK * wide : (c + 1) * CLUSTER_CHUNK * wide]) for c in range(-(-words.value.n // CLUSTER_CHUNK)))

    def merged(batches):
        yield from _chunks(_summed(batches).items())

    made = sliced.select("held", "sizes", "texts").mapInArrow(counted, _CHUNK_ROW)
    total = cut(made.repartition("chunk").mapInArrow(merged, _CHUNK_ROW), "cluster-counts")
    head = _summed(total.where("chunk = 0").toArrow().to_batches()).get(0)
    if head is None:
        return np.zeros(0, dtype=np.int64)
    kinds = _kinds(head.reshape(-1, wide)[:CLUSTERS_BY].astype(float))

    def assigned(batches):
        for c, counts in _summed(batches).items():
            best = (counts.reshape(-1, wide) @ kinds.T).argmax(axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([best.tobytes()], pa.binary())], names=["chunk", "counts"])

    found = total.mapInArrow(assigned, "chunk int, counts binary").toArrow()
    out = np.zeros(size, dtype=np.int64)  # a byte for each token of the vocabulary is gathered
    for c, best in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[c * CLUSTER_CHUNK : (c + 1) * CLUSTER_CHUNK] = np.frombuffer(best, dtype=np.uint8)
    return out


def _kinds(rows: np.ndarray) -> np.ndarray:
    """Log distributions of the clusters of some rows of counts."""
    overall = rows.sum(axis=0) + 1.0
    overall /= overall.sum()

    def logs(groups: np.ndarray) -> np.ndarray:
        smooth = groups + 20.0 * overall
        return np.log(smooth / smooth.sum(axis=1, keepdims=True))

    share = rows / np.maximum(rows.sum(axis=1, keepdims=True), 1)
    chosen, far = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(CLUSTERS, len(rows)):
        far = np.minimum(far, (rows * (np.log(share + 1e-3) - np.log(share[chosen[-1]] + 1e-3))).sum(axis=1))
        chosen.append(int(far.argmax()))
    kinds = logs(rows[chosen])
    for _ in range(20):
        best = (rows @ kinds.T).argmax(axis=1)
        kinds = logs(np.stack([rows[best == k].sum(axis=0) for k in range(len(chosen))]))
    return kinds


def language_model_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for each row.

    A row is held out if the CRC-32 of its key as text leaves 1 modulo 5 (a null key counts
    as the empty text); the others are learnt from.  A null text is the empty one: its only
    token is the end.  ``base_score`` is the log10 probability under unigram counts with 0.5
    added; ``score`` that of the mixed model; ``bits_per_byte`` divides the model's bits by the
    text's UTF-8 bytes plus one for the end.  Repeated rows are learnt from each time and get
    nearly equal results (not quite: a few last
    digits hang on sums of floats); other columns are left out.  Without training rows every
    token is unknown and the model predicts from nothing.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), held_out(F.col(key)).alias("held_out"))
    dev = F.when(~F.col("held_out"), F.pmod(F.xxhash64("key"), F.lit(2)) == 0)  # a half of the training rows; null: none
    sliced = text_slices(own.withColumn("dev", dev))
    size = sliced.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    layout = Layout.of(size)
    known = answers(sliced, layout)
    release(spark)
    about = known.where("slice = -1")
    n, v = about.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    top = about.select(F.explode(F.arrays_zip("hashes", "counts")).alias("x")).select("x.*").orderBy(F.desc("counts"), "hashes").limit(VOCABULARY).toArrow()
    hashes, counts = top.column("hashes").to_numpy().view(np.uint64), top.column("counts").to_numpy()
    words = spark.sparkContext.broadcast(Vocabulary(hashes, counts))
    codes = spark.sparkContext.broadcast(Codes.build(words.value, clusters(sliced, words), n - int(counts.sum()), letter_counts(sliced), n))
    words.unpersist()
    marks, learnt = marked_counts(about), Mixer.fresh()
    *halves, others = answered_parts(sliced, known)
    drop(sliced, known)
    halves = [(rows, cut(context_counts(rows, codes), "context-counts")) for rows in halves]
    for (rows, _), (_, counted) in zip(halves, halves[::-1]):
        other = spark.sparkContext.broadcast(context_table(counted, codes.value))
        learnt = fit_mixer(rows, codes, other, layout, marks, learnt)
        other.unpersist()
        release(spark)
    mixer = spark.sparkContext.broadcast(learnt)
    table = spark.sparkContext.broadcast(context_table(halves[0][1].unionByName(halves[1][1]), codes.value))
    schema = T.StructType([
        T.StructField(key, own.schema["key"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType()),
    ])

    def scored(batches):
        claim(__name__)
        for batch in batches:
            for row, (held, sizes, packed, found) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(1, 5)])):
                t = Tokens(unpack_texts(sizes, packed))
                times = known_counts(t, found)
                begin = t.last + 1 - t.counts
                base = np.add.reduceat(np.log10((times + 0.5) / (n + 0.5 * (v + 1))), begin)
                events, tokens, hits = Events(codes.value, t, told(t, held, found, layout, times, marks)), t.counts.astype(np.int64), np.add.reduceat((times > 0).astype(np.int64), begin)
                del t, found, times  # mixing needs the memory
                score = mixed(events, table.value, mixer.value)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[row].values, pa.array(held, pa.bool_()), pa.array(tokens), pa.array(hits),
                    pa.array(np.full(len(held), n, dtype=np.int64)), pa.array(base), pa.array(score), pa.array(-score / np.log10(2) / (np.array(sizes) + 1)),
                ], names=schema.names)

    return halves[0][0].unionByName(halves[1][0]).unionByName(others).mapInArrow(scored, schema)
