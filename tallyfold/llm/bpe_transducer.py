"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding.  For a proper vocabulary (each token encodes to itself) the last token of
the encoding of a prefix decides the rest: encode(p) = encode(p without t) + t, where
t is the one token that ends p and forms a *stable* pair with the token before it
(merging the bytes of both gives back the two).  Reading bytes one at a time, the
transducer keeps the bytes that are not settled yet and the last token at each place
where a later token could still start.  Places where no token can start any more are
dropped; once all that remain share their first tokens, these are emitted.  How far it
looks ahead is thus bounded by the longest token.  States are made when first reached
and found again by content, so that all words of a corpus share them.  The new words of a
batch of texts take their steps together, byte by byte, through a table of moves.

Decoding.  A state machine for UTF-8 runs over token ids: for each state (how the current
character may go on) and token it knows the state after the token's bytes.  Whole characters
come out at once; the bytes of one that is not complete wait for the next chunk.
"""

from __future__ import annotations

import base64
import struct
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_texts, prepare, remembers, slices
from .pretokens import pretoken_lists, pretokens

#: Pre-tokens, moves and pairs that a Python worker remembers; a full memo starts anew.
REMEMBERED_WORDS = 150_000
REMEMBERED_MOVES = 600_000
REMEMBERED_PAIRS = 100_000
#: Pre-tokens of up to so many bytes take their steps together, and how many of them.
TOGETHER, ABREAST = 48, 10_000
#: Characters of the texts whose new pre-tokens are encoded together.
WORDS_AT_ONCE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file: a base64 text and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack(before: bytes | None, pending: bytes, places: list[tuple[int, int, bool]]) -> bytes:
    """A state as one bytes object: memory is what bounds the number of states."""
    head = struct.pack("<HH", 0xFFFF if before is None else len(before), len(pending))
    return head + (before or b"") + pending + b"".join(struct.pack("<HhB", *x) for x in places)


def unpack(state: bytes) -> tuple[bytes | None, bytes, list[tuple[int, int, bool]]]:
    n, m = struct.unpack_from("<HH", state)
    before, at = (None, 4) if n == 0xFFFF else (state[4 : 4 + n], 4 + n)
    return before, state[at : at + m], [(o, p, bool(x)) for o, p, x in struct.iter_unpack("<HhB", state[at + m :])]


class Moves:
    """A hash table from state and byte to what the move leads to, for many lookups at once."""

    def __init__(self, bits: int = 14):
        self.n, self.bits = 0, bits
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)

    def _slot(self, keys):
        x = keys * 0x9E3779B1
        return ((x ^ x >> 29) & 0x7FFFFFFF) * 0x85EBCA6B >> 20 & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of some keys; -1 where there is none."""
        out, mask = np.full(len(keys), -1, dtype=np.int64), len(self.keys) - 1
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.keys[slot]
            same = there == keys[open_]
            out[open_[same]] = self.values[slot[same]]
            more = ~same & (there >= 0)
            open_, slot = open_[more], slot[more] + 1 & mask
        return out

    def one(self, key: int) -> int:
        """As find, for one key."""
        x, mask = key * 0x9E3779B1, len(self.keys) - 1
        slot = ((x ^ x >> 29) & 0x7FFFFFFF) * 0x85EBCA6B >> 20 & mask
        while (there := int(self.keys[slot])) >= 0:
            if there == key:
                return int(self.values[slot])
            slot = slot + 1 & mask
        return -1

    def put(self, key: int, value: int) -> None:
        if 2 * self.n >= len(self.keys):
            used = np.flatnonzero(self.keys >= 0)
            old, kept = self.keys[used], self.values[used]
            self.__init__(self.bits + 1)
            self.n, slot, mask = len(old), self._slot(old), len(self.keys) - 1
            while len(old):
                slots, first = np.unique(slot, return_index=True)
                first = first[self.keys[slots] < 0]  # one of those that ask for a free place gets it
                self.keys[slot[first]], self.values[slot[first]] = old[first], kept[first]
                left = np.ones(len(old), dtype=bool)
                left[first] = False
                old, kept, slot = old[left], kept[left], slot[left] + 1 & mask
        slot, mask = int(self._slot(np.int64(key))), len(self.keys) - 1
        while (there := self.keys[slot]) >= 0 and there != key:
            slot = slot + 1 & mask
        self.n += there != key
        self.keys[slot], self.values[slot] = key, value


class Transducer:
    """Lazily determinised encoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}  # proper beginnings of tokens
        self.ordered = sorted(ranks)
        self.open: dict[tuple[bytes, bytes], bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[tuple[bytes, bool], tuple | None] = {}
        self.forget()

    def forget(self) -> None:
        # A state: the token before the pending bytes, the pending bytes, and for each place (an offset
        # into them) where tokens meet: the start of the token that ends there, and whether a token may
        # still start there.
        start = pack(b"", b"", [(0, -1, True)])
        self.states, self.numbers = [start], {start: 0}
        self.moves = Moves()  # state and byte -> number of what is emitted, and state
        self.tails = np.full(1024, -1, dtype=np.int64)  # state -> number of what ends a pre-token there
        self.outs, self.out_numbers = [()], {(): 0}  # ids that are emitted together
        self.flat, self.first, self.size = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def emitted(self, tokens: list[bytes]) -> int:
        """The number of a row of tokens that is emitted at once."""
        ids = tuple(map(self.ranks.__getitem__, tokens))
        found = self.out_numbers.setdefault(ids, len(self.outs))
        if found == len(self.outs):
            self.outs.append(ids)
        return found

    def merged(self, data: bytes, below: float = float("inf")) -> list[bytes]:
        """Encoding by merging the lowest rank first, with ranks under ``below`` only: the
        definition, used for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in found if r is not None), default=None)
            if best is None or best >= below:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: bytes, right: bool) -> tuple[tuple[bytes, ...], tuple[float, ...]] | None:
        """The symbols that stand at one end of the token while it is merged, first a byte and at
        last the token, and the rank that replaces each; None if ranks do not rise on the way."""
        found = self.spines.get((token, right), self)
        if found is self:
            symbols, until = [token], [float("inf")]
            while found is self and len(t := symbols[-1]) > 1:
                rank = self.ranks[t]
                parts = self.merged(t, rank)
                if len(parts) != 2 or any(len(p) > 1 and self.ranks[p] >= rank for p in parts):
                    found = None
                symbols.append(parts[-1] if right else parts[0])
                until.append(rank)
            if found is self:
                found = tuple(symbols[::-1]), tuple(until[::-1])
            self.spines[token, right] = found
        return found

    def stands(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b stay as they are next to each other.

        Symbols at the end of a and at the start of b meet while both are merged; the tokens
        stand if no two that meet would merge with each other before one of them is replaced.
        Where ranks are equal, the place further left comes first.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._stand(a, b)
        return found

    def _stand(self, a: bytes, b: bytes) -> bool:
        left, right = self.spine(a, True), self.spine(b, False)
        if left is None or right is None:
            return self.merged(a + b) == [a, b]
        (ends, until_a), (begins, until_b), rank, i, j = left, right, self.ranks.get, 0, 0
        while True:
            p, q = until_a[i], until_b[j]
            m = rank(ends[i] + begins[j])
            if m is not None and m < p and m <= q:
                return False
            if p <= q:
                if i + 1 == len(ends):
                    return True
                i += 1
            else:
                j += 1

    def may_follow(self, prev: bytes, start: bytes) -> bool:
        """Whether some longer token that begins so can stand after token ``prev``."""
        if not prev or start not in self.starts:
            return start in self.starts
        found = self.open.get((prev, start))
        if found is None:
            if len(self.open) > REMEMBERED_PAIRS:
                self.open.clear()
            found, k, n = False, bisect_right(self.ordered, start), len(self.ordered)
            while k < n and (t := self.ordered[k]).startswith(start):
                if self.stands(prev, t):
                    found = True
                    break
                k += 1
            self.open[prev, start] = found
        return found

    def step(self, number: int, byte: int) -> int:
        """The state after one more byte; the tokens that it settles go to ``emits``."""
        before, pending, places = unpack(self.states[number])
        data = pending + bytes([byte])
        end = len(data)
        last = {}  # offset -> start of the token that ends there
        living = []
        for s, p, lives in places:
            last[s] = p
            if lives:
                living.append(s)
        for s in living:  # earliest start first: the longest token
            if (t := data[s:]) in self.ranks:
                prev = before if s == 0 else data[last[s] : s]
                if not prev or self.stands(prev, t):
                    last[end] = s
                    break
        # Offsets on the way back from each place that still lives; those on all ways are settled.
        needed, o = {end}, end
        while o > 0:
            o = last[o]
            needed.add(o)
        common, living = needed.copy(), [s for s in living if self.may_follow(before if s == 0 else data[last[s] : s], data[s:])]
        for o in living:
            way = {o}
            while o > 0:
                o = last[o]
                way.add(o)
            common &= way
            needed |= way
        settled = max(common)
        out, o = [], settled
        while o > 0:
            out.append(data[last[o] : o])
            o = last[o]
        out.reverse()
        living.append(end)
        if settled not in living:
            before = None  # no token starts here any more, so what stands before no longer matters
        elif out:
            before = out[-1]
        state = pack(before, data[settled:], [(o - settled, last[o] - settled if o > settled else -1, o in living) for o in sorted(needed) if o >= settled])
        found = self.numbers.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        value = self.emitted(out) << 32 | found
        self.moves.put(number << 8 | byte, value)
        return value

    def tail(self, state: int) -> int:
        """Number of the tokens that are emitted where a pre-token ends in the state."""
        if state >= len(self.tails):
            self.tails = np.r_[self.tails, np.full(max(len(self.tails), state + 1), -1, dtype=np.int64)]
        if self.tails[state] < 0:
            _, pending, places = unpack(self.states[state])
            last, out, o = {s: p for s, p, _ in places}, [], len(pending)
            while o > 0:
                out.append(pending[last[o] : o])
                o = last[o]
            self.tails[state] = self.emitted(out[::-1])
        return int(self.tails[state])

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        state, out = 0, []
        for byte in data:
            value = self.moves.one(state << 8 | byte)
            if value < 0:
                if self.moves.n > REMEMBERED_MOVES:  # what is known goes, the state stays
                    here = self.states[state]
                    self.forget()
                    state = self.numbers.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                value = self.step(state, byte)
            out += self.outs[value >> 32]
            state = value & 0xFFFFFFFF
        return out + list(self.outs[self.tail(state)])

    def encode_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token (none longer than TOGETHER), as little-endian unsigned 32-bit numbers."""
        if self.moves.n > REMEMBERED_MOVES:
            self.forget()
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        begin, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
        longest = int(size[0])
        outs, state = np.zeros((len(words), longest + 1), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        reach = np.searchsorted(-size, -np.arange(longest), "left")  # words with a byte at each place
        for k, n in enumerate(reach.tolist()):
            keys = state[:n] << 8 | data[begin[:n] + k]
            values = self.moves.find(keys)
            missing = np.flatnonzero(values < 0)
            if len(missing):
                new, of = np.unique(keys[missing], return_inverse=True)
                values[missing] = np.array([self.step(key >> 8, key & 255) for key in new.tolist()])[of]
            outs[:n, k], state[:n] = values >> 32, values & 0xFFFFFFFF
        ends, of = np.unique(state, return_inverse=True)
        outs[:, longest] = np.array([self.tail(s) for s in ends.tolist()])[of]
        if len(self.outs) > len(self.first):
            new = self.outs[len(self.first) :]
            size_new = np.array([len(x) for x in new], dtype=np.int64)
            self.first = np.r_[self.first, len(self.flat) + np.cumsum(size_new) - size_new]
            self.size = np.r_[self.size, size_new]
            self.flat = np.r_[self.flat, np.array([i for x in new for i in x], dtype="<u4")]
        outs = outs[np.argsort(order)].ravel()
        outs = outs[: len(words) * (longest + 1)]
        n = self.size[outs]
        edges = np.r_[0, np.cumsum(n)]
        ids = self.flat[np.repeat(self.first[outs] - edges[:-1], n) + np.arange(edges[-1])].tobytes()
        edges = (4 * edges[:: longest + 1]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.packed = {t: struct.pack("<I", r) for t, r in self.ranks.items()}
        self.known: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        together: list[str] = []
        for w in words:
            data = w.encode()
            whole = self.packed.get(data)  # a pre-token that is a token stays whole
            if whole is not None:
                self.known[w] = whole
            elif len(data) > TOGETHER:
                ids = self.transducer.encode(data)
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                together.append(w)
        for k in range(0, len(together), ABREAST):
            some = together[k : k + ABREAST]
            self.known.update(zip(some, self.transducer.encode_all([w.encode() for w in some])))

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the new pre-tokens of several texts are encoded together."""
        out: list[bytes] = []
        for a, b in slices([len(x) for x in texts], WORDS_AT_ONCE):
            if b == a + 1:
                out.append(self.text(texts[a]))
                continue
            lists = [pretokens(x) for x in texts[a:b]]
            need = set().union(*lists)
            if new := need.difference(self.known):
                self.learn(new)
                if gone := need.difference(self.known):  # the memo started anew
                    self.learn(gone)
            get = self.known.__getitem__
            out += [b"".join(map(get, x)) for x in lists]
        return out

    def text(self, text: str) -> bytes:
        """The ids of one text, which may be very long."""
        out = []
        for pieces in pretoken_lists(text):
            need = set(pieces)
            if new := need.difference(self.known):
                self.learn(new)
                if gone := need.difference(self.known):
                    self.learn(gone)
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return b"".join(out)


def _utf8_steps() -> np.ndarray:
    """State by state and byte: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 first bytes with narrower second
    bytes (after E0, ED, F0, F4), 8 no UTF-8."""
    step = np.full((9, 256), 8, dtype=np.uint8)
    step[0, :0x80] = 0
    step[0, 0xC2:0xE0], step[0, 0xE0:0xF0], step[0, 0xF0:0xF5] = 1, 2, 3
    step[0, [0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    for state, low, high, then in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        step[state, low:high] = then
    return step


class TokenTable:
    """The bytes of each id, and the UTF-8 state that they lead to from each state."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.pieces[r] = t
        step, sizes = _utf8_steps(), np.array([len(t) for t in self.pieces])
        data, first = np.frombuffer(b"".join(self.pieces), dtype=np.uint8), np.cumsum(sizes) - sizes
        self.after = np.tile(np.arange(9, dtype=np.uint8), (len(sizes), 1))
        for k in range(int(sizes.max())):
            some = np.flatnonzero(sizes > k)
            self.after[some] = step[self.after[some], data[first[some] + k][:, None]]


class Utf8Stream:
    """Incremental UTF-8 state machine over token ids.

    ``feed`` gives the bytes of all complete characters; those of a character that is cut by
    the chunk's end wait for the next chunk, or for ``close``.  Bytes that are no UTF-8 come
    out as they are and set ``valid`` to false, as does a character that ``close`` finds incomplete.
    """

    def __init__(self, table: TokenTable):
        self.table, self.state, self.held, self.valid = table, 0, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        after, state, k = self.table.after, self.state, 0
        cuts = np.flatnonzero(after[ids, 0])  # tokens that do not end where a character does, if they begin where one does
        while k < len(ids):
            if state == 0:
                at = np.searchsorted(cuts, k)
                if at == len(cuts):
                    break
                k = cuts[at]
            elif state == 8:
                break
            state = int(after[ids[k], state])
            k += 1
        data = self.held + b"".join(map(self.table.pieces.__getitem__, ids.tolist()))
        self.state, waits = state, 0
        if state == 8:
            self.valid = False
        elif state:
            waits = next(n for n in (1, 2, 3) if data[-n] & 0xC0 == 0xC0)  # back to the character's first byte
        self.held = data[len(data) - waits :]
        return data[: len(data) - waits]

    def close(self) -> bytes:
        self.valid &= not self.held
        held, self.held = self.held, b""
        return held


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


remembers(__name__, lambda: (_encoder.cache_clear(), _tokens.cache_clear()))


@lru_cache(2)
def _tokens(path: str) -> TokenTable:
    return TokenTable(path)


def _decoded(rows: list[bytes | None], path: str, chunk: int) -> tuple[list[bytes], list[bool]]:
    decoded, valid = [], []
    for row in rows:
        ids, stream = np.frombuffer(row or b"", dtype="<u4"), Utf8Stream(_tokens(path))
        out = [stream.feed(ids[k : k + chunk]) for k in range(0, len(ids), chunk)]
        decoded.append(b"".join([*out, stream.close()]))
        valid.append(stream.valid)
    return decoded, valid


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, chunk: int = 1 << 16) -> DataFrame:
    """encode_texts, then decode_ids, in one pass over the rows."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def function(texts: list[str]) -> list:
        ids = _encoder(path).texts(texts)
        return [ids, [len(x) // 4 for x in ids], *_decoded(ids, path, chunk)]

    fields = [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.BinaryType()), ("valid_utf8", T.BooleanType())]
    return map_texts(df, text, keep, [T.StructField(*f) for f in fields], function)


def encode_texts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` (the ids as little-endian unsigned 32-bit numbers) and ``n_tokens``.

    A null text is the empty one: no ids.  Each input row gives one row, equal rows
    included; other columns are left out.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def function(texts: list[str]) -> list:
        ids = _encoder(path).texts(texts)
        return [ids, [len(x) // 4 for x in ids]]

    return map_texts(df, text, keep, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], function)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", chunk: int = 1 << 16) -> DataFrame:
    """All columns, then ``decoded`` (bytes) and ``valid_utf8``, made chunk by chunk.

    Null ids decode to no bytes.  An id outside the vocabulary raises.
    """
    prepare(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("valid_utf8", T.BooleanType())])
    place = df.columns.index(ids)
    names = schema.names

    def run(batches):
        claim(__name__)
        for batch in batches:
            decoded, valid = _decoded(batch.column(place).to_pylist(), path, chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary()), pa.array(valid, pa.bool_())], names=names)

    return df.mapInArrow(run, schema)


def decoded_texts(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """As decode_ids, with a ``text`` column instead of the bytes; null where they are not UTF-8."""
    out = decode_ids(df, path, ids)
    return out.withColumn("text", F.when(F.col("valid_utf8"), F.col("decoded").cast("string"))).drop("decoded")
