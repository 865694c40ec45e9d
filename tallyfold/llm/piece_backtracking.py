"""SentencePiece encoding of merge-type models by backtracking, and decoding.

The model's own process merges, again and again, the adjacent pair whose joined text is the
piece of the best score (the leftmost of equal ones) until no pair is a piece.  Its result is the
one sequence of pieces in which every two neighbours, merged anew on their own, come out as
these two: until a first merge crosses a border, the merges inside any two neighbours are
those of the two alone, so that a crossing merge would show there as well.  So pieces are laid
from left to right: the longest piece at a place that goes with the piece before it, else the
next shorter one, else one step back.  A prefix has one such sequence only; hence a place at which
no piece fits is marked as failed in a bitfield and not entered again, and the time is linear.

Longest pieces come from an Aho-Corasick automaton of reversed pieces, which at every end in the
reversed text knows the longest piece that begins there.  Spaces become U+2581, with one more in
front.  No merge crosses a place whose two characters are side by side in no piece: texts are cut
there first, and stretches that repeat are looked up.  A character in no piece is written as its
UTF-8 bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import claim, map_texts, prepare, remembers

SPACE = "▁"
#: Stretches and pairs of pieces that a Python worker remembers, each; when full it starts anew.
REMEMBERED = 600_000
#: Longer stretches are not remembered.
LONG_STRETCH = 64
#: Characters of a text that are looked at together.
WINDOW = 1_000_000
UNKNOWN = -1
NONE = float("inf")


class PieceModel:
    """Pieces, scores and the automaton of a merge-type model.

    The normalizer must be the identity with a space in front, and every character of a piece must
    be a piece itself; else ValueError.
    """

    def __init__(self, path: str):
        spec = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = spec.get_piece_size()
        if spec.normalize(" ａ  b ") != f"{SPACE}{SPACE}ａ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models that change nothing but spaces and put one in front")
        special = {k for k in range(self.size) if spec.is_control(k) or spec.is_unknown(k) or spec.is_byte(k)}
        normal = {k: spec.id_to_piece(k) for k in range(self.size) if k not in special}
        if any(spec.is_unused(k) for k in normal):
            raise ValueError("a piece is unused")
        self.ids = {p: k for k, p in normal.items()}
        if not {c for p in normal.values() for c in p} <= self.ids.keys():
            raise ValueError("a character of a piece is no piece")
        self.order = {p: -spec.get_score(k) for k, p in normal.items()}
        self.text = [""] * self.size
        self.surface = [b""] * self.size
        for k, p in normal.items():
            self.text[k], self.surface[k] = p, p.replace(SPACE, " ").encode()
        self.of_byte = [spec.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, k in enumerate(self.of_byte):
            self.surface[k] = bytes([b])
        self.byte = np.zeros(self.size, dtype=bool)
        self.byte[self.of_byte] = True
        self.control = np.array([spec.is_control(k) for k in range(self.size)])
        for k in special - set(np.flatnonzero(self.control).tolist()) - set(self.of_byte):
            self.surface[k] = spec.decode([k]).encode()
        self.bytes = np.frombuffer(b"".join(self.surface), dtype=np.uint8)
        self.width = np.array(list(map(len, self.surface)))
        self.begin = np.cumsum(self.width) - self.width
        self.spaced = np.array([p.startswith(SPACE) for p in self.text])
        self.length = list(map(len, self.text))
        self.shorter = [next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), UNKNOWN) for p in self.text]
        self.backward = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.backward.add_word(p[::-1], k)
        self.backward.make_automaton()
        # Number of each character that is in a piece (0: in none), and which of them stand side by side.
        known = sorted({c for p in self.ids for c in p})
        self.number = np.zeros(0x110000, dtype=np.uint16)
        self.number[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.across = len(known) + 1
        self.beside = np.zeros(self.across**2, dtype=bool)
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.beside[[int(self.number[ord(a)]) * self.across + int(self.number[ord(b)]) for a, b in pairs]] = True
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's own process on a short text."""
        parts, order = list(text), self.order
        ranks = [order.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NONE:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = order.get(parts[k - 1] + parts[k], NONE)
            if k < len(ranks):
                ranks[k] = order.get(parts[k] + parts[k + 1], NONE)
        return parts

    def goes_with(self, left: int, right: int) -> bool:
        """Whether two neighbours (left: UNKNOWN for none) stay as they are when they are merged anew."""
        a, b = self.text[left] if left != UNKNOWN else "", self.text[right]
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        known = self.fits[left * self.size + right] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def longest(self, word: str) -> list[int]:
        """The longest piece that begins at each place, UNKNOWN where none does."""
        out, last = [UNKNOWN] * len(word), len(word) - 1
        before = UNKNOWN
        for end, piece in self.backward.iter(word[::-1]):  # the longest of an end comes first
            if end != before:
                out[last - end], before = piece, end
        return out

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text cut wherever two neighbours are side by side in no piece, in lists."""
        begin = 0
        for at in range(0, len(text), WINDOW):
            here = self.number[np.frombuffer(text[at : at + WINDOW + 1].encode("utf-32-le"), dtype="<u4")].astype(np.int32)
            cuts = [begin, *(np.flatnonzero(~self.beside[here[:-1] * self.across + here[1:]]) + at + 1).tolist()]
            begin = cuts[-1]
            yield [text[a:b] for a, b in zip(cuts, cuts[1:])]
        yield [text[begin:]]

    def laid(self, word: str) -> list[int]:
        """Ids of a stretch by backtracking; bytes stand for a character in no piece."""
        size, longest = len(word), self.longest(word)
        if size == 1 and longest[0] == UNKNOWN:
            return [self.of_byte[b] for b in word.encode()]
        failed = bytearray(size // 8 + 1)
        fits, length, shorter, most = self.fits, self.length, self.shorter, self.size
        out: list[int] = []
        at, piece, last = 0, longest[0], UNKNOWN
        while at < size:
            while piece != UNKNOWN:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    good = fits.get(last * most + piece)
                    if good or good is None and self.goes_with(last, piece):
                        break
                piece = shorter[piece]
            if piece != UNKNOWN:
                out.append(piece)
                at, last = end, piece
                piece = longest[at] if at < size else UNKNOWN
            elif out:
                failed[at >> 3] |= 1 << (at & 7)
                piece = shorter[out.pop()]
                at -= length[last]
                last = out[-1] if out else UNKNOWN
            else:
                raise AssertionError(f"no pieces for {word[:40]!r}")
        return out

    def looked_up(self, parts: list[str]) -> list[bytes]:
        """Ids of stretches, each given once, as 32-bit numbers."""
        known = self.known
        new = [p for p in parts if p not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = parts
        long = {}
        for part in new:
            (known if len(part) <= LONG_STRETCH else long)[part] = array("i", self.laid(part)).tobytes()
        return [long.get(p) or known[p] for p in parts] if long else list(map(known.__getitem__, parts))

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, however long, window by window."""
        out = []
        if text:
            for parts in self.stretches(SPACE + text.replace(" ", SPACE)):
                once = list(set(parts))
                of = dict(zip(once, self.looked_up(once)))
                out.extend(map(of.__getitem__, parts))
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (and the last one's end).  Stretches are told apart and
        put together as arrays; each distinct one is looked up once."""
        if sum(map(len, texts)) > 4 * WINDOW:
            rows = list(map(self.encode, texts))
            return np.concatenate([np.zeros(0, np.int32), *rows]), np.cumsum([0, *map(len, rows)])
        joined = "".join(SPACE + x.replace(" ", SPACE) for x in texts if x)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        here = self.number[codes].astype(np.int32)
        begins = np.r_[True, ~self.beside[here[:-1] * self.across + here[1:]]]
        edges = np.cumsum([0, *[len(x) + 1 if x else 0 for x in texts]])
        begins[edges[edges < len(codes)]] = True
        place = np.flatnonzero(begins)
        widths = np.cumsum((codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000) + np.uint8(1), dtype=np.int64)
        data = joined.encode()
        ends = np.r_[0, widths[place[1:] - 1], len(data)].astype(np.int64)
        told = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        ids, which = self.looked_up(told.dictionary.to_numpy(zero_copy_only=False).tolist()), told.indices.to_numpy()
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        upto = np.r_[0, np.cumsum(sizes[which])]
        return _picked(np.frombuffer(b"".join(ids), dtype=np.int32), np.cumsum(sizes) - sizes, sizes, which, upto), upto[np.searchsorted(place, edges)]

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """Texts of the ids between edges."""
        self._check(ids)
        filled = np.flatnonzero(np.diff(edges))
        if len(ids) < 4 * WINDOW and not self.control[ids].any():
            upto = np.r_[0, np.cumsum(self.width[ids])]
            data = _picked(self.bytes, self.begin, self.width, ids, upto)
            firsts = edges[filled]
            spaced = self.spaced[ids[firsts]]  # whose first sign goes
            keep = np.ones(len(data), dtype=bool)
            keep[upto[firsts[spaced]]] = False
            gone = np.zeros(len(edges) - 1, dtype=np.int64)
            gone[filled[spaced]] = 1
            ends = upto[edges] - np.r_[0, np.cumsum(gone)]
            data = data[keep]
            starts = ends[:-1][np.diff(ends) > 0]
            try:  # no text may begin inside a character
                if not ((data[starts] & 0xC0) == 0x80).any():
                    data.tobytes().decode()
                    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
            except UnicodeDecodeError:
                pass
        return pa.array([self.decode(ids[a:b]) for a, b in zip(edges, edges[1:])], pa.string())

    def _check(self, ids: np.ndarray) -> None:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id outside the vocabulary")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: signs for spaces are spaces again, one in front goes, bytes become characters; a byte that is
        part of no character becomes U+FFFD."""
        self._check(ids)
        pieces = list(map(self.surface.__getitem__, ids.tolist()))
        control = self.control[ids]
        first = int((~control).argmax()) if len(ids) else 0
        if len(ids) and self.text[ids[first]].startswith(SPACE):
            pieces[first] = pieces[first][1:]
        if not control.any():  # these part bytes
            try:
                return b"".join(pieces).decode()
            except UnicodeDecodeError:
                pass
        runs, is_byte = [], self.byte[ids]
        cuts = [0, *(np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            runs.append(_characters(b"".join(pieces[a:b])))
        return "".join(runs)


def _picked(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The slices ``which`` of ``flat`` (by begin and size) end to end; ``upto``: where they begin in the result, and its end."""
    return flat[np.repeat(begin[which] - upto[:-1], size[which]) + np.arange(upto[-1])]


def _characters(data: bytes) -> str:
    """As UTF-8, with U+FFFD for each byte that is part of no character."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
            except UnicodeDecodeError:
                continue
            if at + n <= len(data):
                at += n
                break
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


remembers(__name__, lambda: _model.cache_clear())

IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def _listed(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids), type=pa.list_(pa.field("element", pa.int32(), False)))


def piece_round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``ids``, ``n_tokens`` and ``decoded``, the text made from the ids again.

    A null text is the empty one: no ids, decoded ''.  Each input row gives one row, equal
    rows included; other columns are left out.  An empty table gives an empty result.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def function(texts: list[str]) -> list:
        ids, edges = _model(path).encode_all(texts)
        return [_listed(ids, edges), np.diff(edges), _model(path).decode_all(ids, edges)]

    return map_texts(df, text, keep, [IDS, T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())], function)


def encode_pieces(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` and ``n_tokens``; rows as in piece_round_trip."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def function(texts: list[str]) -> list:
        ids, edges = _model(path).encode_all(texts)
        return [_listed(ids, edges), np.diff(edges)]

    return map_texts(df, text, keep, [IDS, T.StructField("n_tokens", T.LongType())], function)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", made: str = "decoded") -> DataFrame:
    """All columns and the text of the ids as column ``made``.  Null ids give '', as do none; an id outside the vocabulary raises."""
    prepare(df.sparkSession)
    if made in df.columns:
        raise ValueError(f"there is a column {made} already")
    schema = T.StructType([*df.schema.fields, T.StructField(made, T.StringType())])
    place, names = df.columns.index(ids), schema.names

    def run(batches):
        claim(__name__)
        for batch in batches:
            rows = [np.array(r or [], dtype=np.int64) for r in batch.column(place).to_pylist()]
            texts = _model(path).decode_all(np.concatenate([np.zeros(0, np.int64), *rows]), np.cumsum([0, *map(len, rows)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=names)

    return df.mapInArrow(run, schema)
