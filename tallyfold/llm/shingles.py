"""Word shingles as 64-bit hashes, for many texts at once.

A word is a run of bytes other than ASCII white space.  Word hashes are differences of
a running sum of byte values times powers of an odd base (mod 2^64), shifted to a common
place; a shingle's hash mixes those of five words in a row.  A text of one to four words
is one shingle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes hashed at once (a longer word is one piece); a worker holds 16 bytes of powers for each.
PIECE = 1 << 18
U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.ones(n, dtype=np.uint64)
        k = 1
        while k < n:  # doubling: p[k:2k] = p[:k] * b^k
            m = min(k, n - k)
            p[k : k + m] = p[:m] * U(pow(b, k, 1 << 64))
            k *= 2
        out.append(p)
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def folded() -> tuple[np.ndarray, np.ndarray]:
    """Byte values and separators for words that differ in neither ASCII case nor punctuation."""
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    values = _BYTE[np.where(upper, code + 32, code)]
    word = upper | ((code >= 97) & (code <= 122)) | ((code >= 48) & (code <= 57)) | (code >= 128)
    return values, ~word


def word_spans(data: np.ndarray, values: np.ndarray = _BYTE, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word in order.  Powers are needed for one piece at a time only."""
    space = separators[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) < len(starts):
        ends = np.r_[ends, len(data)]
    hashes, a = np.empty(len(starts), dtype=np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        power, inverse = _powers(max(PIECE, 1 << (high - low).bit_length()))
        total = np.empty(high - low + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(values[data[low:high]] * power[: high - low], out=total[1:])
        first, last = starts[a:b] - low, ends[a:b] - low
        hashes[a:b] = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
        a = b
    return hashes, starts, ends


def word_hashes(texts: list[bytes], values: np.ndarray = _BYTE, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    hashes, starts, _ = word_spans(np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), values, separators)
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, firsts))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and the number of shingles of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    if len(words) >= WORDS:
        k = len(words) - WORDS + 1
        h = words[:k] * _PLACE[0]
        for j in range(1, WORDS):
            h = h + words[j : j + k] * _PLACE[j]
        h = mix(h)
        # A shingle may not reach into the next text.
        owner = np.repeat(np.arange(len(texts)), counts)
        inside = owner[:k] == owner[WORDS - 1 :]
        h, owner = h[inside], owner[:k][inside]
    else:
        h, owner = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        own = [mix((words[ends[i] - counts[i] : ends[i]] * _PLACE[: counts[i]]).sum(keepdims=True) + U(counts[i]))[0] for i in short]
        h, owner = np.r_[h, np.array(own, dtype=np.uint64)], np.r_[owner, short]
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return h, np.bincount(owner, minlength=len(texts))


def distinct_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (ascending inside a text), how often each occurs there, and how many each text has."""
    h, counts = shingle_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((h, owner))
    h = h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(h)])
    return h[at], times, np.bincount(owner[at], minlength=len(texts))
