"""Suffixes in order with their common prefixes, by external induced sorting.

A suffix rises or falls as its first symbol differs from the next one.  Suffixes that begin
a rise after a fall (the stars) are sorted first: the stretches from star to star are named
in order, and the string of names is sorted in the same way, for LEVELS levels; names of the
last one are doubled until they differ or cover DEPTH symbols.  From the stars the falling suffixes are induced by one sweep
in ascending order, and from these the rising ones by a descending sweep: whatever comes out
in order puts the suffix one place further left into a priority queue, under its own first
symbol.

Queues hold tuples of (symbol, place, common prefix).  Symbols never fall behind the sweep,
so that a queue is a row of slots by ranges of symbols: a slot is sorted when the sweep
reaches it, equal symbols in the order in which they came.  Beyond a budget of bytes tuples
wait in files.  The common prefix of two suffixes that were induced one after the other under
one symbol is one more than the least common prefix between their sources, which is carried
along for each symbol; those of stars are read off the text.  All common prefixes end at
LONGEST.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Common prefixes are known up to LONGEST symbols, and suffixes are in the order of DEPTH symbols at least.
LONGEST, DEPTH = 50, 64
#: Levels that are induced.  Deeper ones have nearly as many names as places, and their sweeps too many steps.
LEVELS = 2
QUEUE_BYTES = 48 << 20
_KINDS = (np.dtype(np.int32), np.dtype(np.int32), np.dtype(np.uint8))  # symbol, place, common prefix
_SIZE = sum(k.itemsize for k in _KINDS)
Tuples = tuple[np.ndarray, np.ndarray, np.ndarray]


def nothing() -> Tuples:
    return tuple(np.empty(0, dtype=k) for k in _KINDS)


class Slots:
    """Tuples by slot, in the order in which they came; beyond ``budget`` bytes they wait in a file."""

    def __init__(self, n: int, budget: int):
        self.n, self.budget, self.held, self.spilled, self.file = n, budget, 0, 0, None
        self.parts: list[list] = [[] for _ in range(n)]

    def put(self, slot: int, tuples: Tuples) -> None:
        size = _SIZE * len(tuples[0])
        if self.held + size <= self.budget:
            self.held += size
            self.parts[slot].append(tuples)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.parts[slot].append((self.file.tell(), len(tuples[0])))
        for x in tuples:
            self.file.write(np.ascontiguousarray(x).tobytes())
        self.spilled += size

    def take(self, slot: int) -> Tuples:
        """All of a slot, which is then empty."""
        found = []
        for part in self.parts[slot]:
            if len(part) == 3:
                self.held -= _SIZE * len(part[0])
                found.append(part)
            else:
                self.file.seek(part[0])
                found.append(tuple(np.frombuffer(self.file.read(part[1] * k.itemsize), dtype=k) for k in _KINDS))
        self.parts[slot] = []
        if len(found) == 1:
            return found[0]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else nothing()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class PriorityQueue:
    """Tuples that leave slot by slot, by symbol, equal symbols as they came.  A slot is a range of ``1 << shift`` symbols."""

    def __init__(self, symbols: int, slots: int, budget: int):
        self.shift = max(0, math.ceil(math.log2(max(1, symbols / max(1, slots)))))
        self.slots = Slots(((symbols - 1) >> self.shift) + 1, budget)

    def push(self, tuples: Tuples, ordered: bool = False) -> None:
        """``ordered``: the symbols do not fall."""
        slot = (tuples[0] >> self.shift).astype(np.uint16)  # 16 bits are sorted by radix
        if len(slot) > 1 and not ordered:
            order = np.argsort(slot, kind="stable")
            slot, tuples = slot[order], tuple(x[order] for x in tuples)
        edges = [0, *(np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist(), len(slot)]
        for k, a, b in zip(slot[edges[:-1]].tolist() if len(slot) else [], edges, edges[1:]):
            self.slots.put(k, (tuples[0][a:b], tuples[1][a:b], tuples[2][a:b]))

    def pop(self, slot: int) -> Tuples:
        tuples = self.slots.take(slot)
        if self.shift and len(tuples[0]) > 1:
            inside = tuples[0] & ((1 << self.shift) - 1)
            order = np.argsort(inside.astype(np.uint16) if self.shift <= 16 else inside, kind="stable")
            tuples = tuple(x[order] for x in tuples)
        return tuples


class Carried:
    """For each symbol (of 16 bits at most) the least common prefix among the suffixes that came out since one was last pushed under it."""

    def __init__(self, symbols: int):
        self.least = np.zeros(symbols, dtype=np.uint8)

    def pushed(self, common: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Common prefixes of what is pushed: ``common`` are those of the suffixes that come out now (each with the one
        before), ``at`` which of them push something, and under which ``symbols``, which do not fall (equal ones in the order
        in which they come out)."""
        n, out = len(common), np.empty(len(at), dtype=np.uint8)
        if len(at):
            first = np.r_[True, symbols[1:] != symbols[:-1]]
            low = np.where(first, 0, np.r_[0, at[:-1] + 1])
            level = np.frexp((at - low + 1).astype(np.float64))[1] - 1
            table, half = common, 1  # the least of ``half`` common prefixes from each place on
            for k in range(int(level.max()) + 1):
                if k:
                    table, half = np.minimum(table[:-half], table[half:]), 2 * half
                own = np.flatnonzero(level == k)
                if len(own):
                    out[own] = np.minimum(table[low[own]], table[at[own] - (half - 1)])
            starts = np.flatnonzero(first)
            out[starts] = np.minimum(out[starts], self.least[symbols[starts]])
            np.minimum(out + np.uint8(1), LONGEST, out=out)
        if n:
            np.minimum(self.least, common.min(), out=self.least)
            if len(at):
                last = np.r_[starts[1:], len(at)] - 1
                after = np.r_[np.minimum.accumulate(common[::-1])[::-1], np.uint8(LONGEST)]
                self.least[symbols[last]] = after[at[last] + 1]
        return out


class Level:
    """A string of symbols from 1 on, ended by a 0, and what sorting it needs."""

    def __init__(self, text: np.ndarray, symbols: int, budget: int, level: int = 0):
        self.text, self.symbols, self.budget, self.level, self.spilled = text, symbols, budget, level, 0
        n = len(text)
        change = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=np.int32), np.int32(n))
        change = np.minimum.accumulate(change[::-1])[::-1]  # the next place whose symbol differs from the one after it
        self.rising = np.ones(n, dtype=bool)
        self.rising[:-1] = text[change] < text[change + 1]
        self.stars = np.flatnonzero(self.rising[1:] & ~self.rising[:-1]) + 1

    def run(self, place: int) -> int:
        """How often the symbol at a place is repeated from there on."""
        window = self.text[place : place + LONGEST]
        other = np.flatnonzero(window != window[0])
        return int(other[0]) if len(other) else len(window)

    def star_names(self) -> np.ndarray:
        """A number for each star's stretch to the next star, in their order and equal for equal ones.  Types count with the
        symbols, so that no stretch is the beginning of another one."""
        stars, n = self.stars, len(self.text)
        sizes = np.r_[np.diff(stars) + 1, 1]
        bits = (2 * self.symbols + 1).bit_length()
        per = 64 // bits
        coded = np.zeros(n + per, dtype=np.int32)
        coded[:n] = self.text
        coded[:n] += coded[:n] + self.rising + np.int32(1)
        rank, active, offset = np.zeros(len(stars), dtype=np.int64), np.arange(len(stars)), 0
        while len(active):
            at, more = stars[active] + offset, sizes[active] - offset
            key = np.zeros(len(active), dtype=np.uint64)
            for j in range(per):
                key <<= np.uint64(bits)
                key |= np.where(j < more, coded[at + j], 0).view(np.uint32)
            order = np.argsort(key)  # stretches that are equal so far are named alike, in whatever order they come
            new = np.r_[True, (found := key[order])[1:] != found[:-1]]
            if offset:  # inside the groups that were alike
                key = np.empty(len(active), dtype=np.int64)
                key[order] = np.cumsum(new)
                key += rank[active] << 32
                order = np.argsort(key)
                new = np.r_[True, (found := key[order])[1:] != found[:-1]]
            active = active[order]
            group = rank[active]
            new_group = np.r_[True, group[1:] != group[:-1]]
            start, begin = np.flatnonzero(new), np.flatnonzero(new_group)
            alike = np.diff(np.r_[start, len(new)])
            rank[active] = group + np.repeat(start, alike) - np.repeat(begin, np.diff(np.r_[begin, len(new)]))
            offset += per
            active = active[np.repeat(alike > 1, alike) & (sizes[active] > offset)]
        return rank

    def sorted_stars(self) -> np.ndarray:
        """The stars in the order of their suffixes."""
        rank = self.star_names()
        there = np.zeros(len(rank), dtype=bool)
        there[rank] = True
        names, dense = np.flatnonzero(there), (np.cumsum(there) - 1)[rank]
        covered = 2 << self.level  # symbols of the first level that a name has at least
        if self.level + 1 >= LEVELS:
            n = len(rank)
            while len(names) < n and covered < DEPTH:
                span = covered // (2 << self.level)
                names, dense = np.unique((dense + 1) * (n + 1) + np.r_[dense[span:] + 1, np.zeros(min(span, n), dtype=np.int64)][:n], return_inverse=True)
                covered *= 2
            return self.stars[np.argsort(dense, kind="stable")]
        if len(names) == len(rank) or covered >= DEPTH:
            return self.stars[np.argsort(rank, kind="stable")]
        # The last star is the end alone, whose name is the least and occurs once: it ends the string of names too.
        below = Level(dense.astype(np.int32), len(names), self.budget, self.level + 1)
        order = np.concatenate([places for _, places, _ in below.suffixes(None)][::-1])
        self.spilled += below.spilled
        return self.stars[order]

    def _sweep(self, queue: PriorityQueue, wanted: np.ndarray, symbol: Callable, extras: Callable[[int], Tuples], carried: Carried | None) -> Iterator[tuple[int, Tuples]]:
        """Slot by slot the suffixes that are induced there, in order.  ``extras`` gives a slot's further sources, which come
        after the induced ones of their symbol."""

        none = self.symbols  # where nothing is induced
        left = np.full(len(self.text), none, dtype=self.text.dtype)
        np.copyto(left[1:], symbol(self.text[:-1]), where=wanted[:-1])

        def pushes(places: np.ndarray, common: np.ndarray) -> Tuples:
            symbols = left[places]
            at = np.flatnonzero(symbols < none)
            symbols = symbols[at].astype(np.int32)
            order = np.argsort(symbols.astype(np.uint16) if none <= 1 << 16 else symbols, kind="stable")
            at, symbols = at[order], symbols[order]
            return symbols, places[at] - np.int32(1), carried.pushed(common, at, symbols) if carried is not None else np.zeros(len(at), dtype=np.uint8)

        def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.argsort(np.concatenate([a, b]), kind="stable")  # equal symbols of ``a`` first

        for slot in range(queue.slots.n):
            # Besides the tuple, what each suffix induces.
            now, more = ((*x, left[x[1]]) for x in (queue.pop(slot), extras(slot)))
            end, done = (slot + 1) << queue.shift, []
            while len(now[0]) or len(more[0]):
                low = min(int(x[0][0]) for x in (now, more) if len(x[0]))
                high = low + 1
                if queue.shift:  # below the least symbol that the slot's own suffixes induce, nothing comes in any more
                    high = max(high, min([end, *(int(x[3].min()) for x in (now, more) if len(x[0]))]))
                a, b = (int(np.searchsorted(x[0], high)) for x in (now, more))
                here, there = tuple(x[:a] for x in now), tuple(x[:b] for x in more)
                now, more = tuple(x[a:] for x in now), tuple(x[b:] for x in more)
                if high > low + 1 and carried is None:
                    done.append(here[:3])
                    if b:
                        order = merged(here[0], there[0])
                        here = tuple(np.concatenate(x)[order] for x in zip(here, there))
                    at = np.flatnonzero(here[3] < none)
                    new = here[3][at], here[1][at] - np.int32(1), np.zeros(len(at), dtype=np.uint8)
                    stays = new[0] < end
                    queue.push(tuple(x[~stays] for x in new))
                    entered = [tuple(x[stays] for x in new)]
                else:  # one symbol: what it induces under itself follows at once
                    last, entered, here = None, [], here[:3]
                    while len(here[0]):
                        if carried is not None and last is None:
                            here = here[0], here[1], np.r_[np.uint8(0), here[2][1:]]
                        done.append(here)
                        last = int(here[1][-1])
                        new = pushes(here[1], here[2])
                        same = int(np.searchsorted(new[0], low, "right"))
                        entered.append(tuple(x[same:] for x in new))
                        here = tuple(x[:same] for x in new)
                    if b:
                        common = there[2].copy()
                        common[0] = 0 if last is None or carried is None else min(self.run(last), self.run(int(there[1][0])), LONGEST)
                        entered.append(pushes(there[1], common))
                    for k, new in enumerate(entered):
                        stays = int(np.searchsorted(new[0], end))
                        queue.push(tuple(x[stays:] for x in new), ordered=True)
                        entered[k] = tuple(x[:stays] for x in new)
                for new in entered:
                    if len(new[0]):
                        order = merged(now[0], new[0])
                        now = tuple(np.concatenate(x)[order] for x in zip(now, (*new, left[new[1]])))
            yield slot, tuple(np.concatenate(x) for x in zip(*done)) if done else nothing()

    def suffixes(self, common_prefixes: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> Iterator[Tuples]:
        """Slot by slot, from the largest symbols to the least, the suffixes in ascending order: first symbols, places, common
        prefixes with the one before (of the slot).  ``common_prefixes`` reads those of stars off the text; without it none
        are known."""
        stars, text, top = self.sorted_stars(), self.text, self.symbols - 1
        wide = common_prefixes is None
        slots = min(1024, max(16, math.isqrt(len(text)) // 4)) if wide else self.symbols
        queue = PriorityQueue(self.symbols, slots, self.budget)
        first = text[stars].astype(np.int32)
        common = np.zeros(len(stars), dtype=np.uint8)
        if not wide and len(stars) > 1:
            common[1:] = np.minimum(common_prefixes(stars[:-1], stars[1:]), LONGEST)
        edges = np.searchsorted(first, np.arange(queue.slots.n + 1) << queue.shift)
        stars = stars.astype(np.int32)

        def seeds(slot: int) -> Tuples:
            a, b = edges[slot], edges[slot + 1]
            return first[a:b], stars[a:b], common[a:b]

        falling = Slots(queue.slots.n, self.budget)
        for slot, found in self._sweep(queue, ~self.rising, lambda s: s, seeds, None if wide else Carried(self.symbols)):
            if len(found[0]):
                falling.put(slot, found)
        queue.slots.close()
        self.spilled += queue.slots.spilled + falling.spilled
        queue = PriorityQueue(self.symbols, slots, self.budget)
        kept: dict[int, Tuples] = {}
        shift = queue.shift

        def fallen(slot: int) -> Tuples:
            # Symbols are counted from the top here: a slot holds parts of two slots of the first sweep at most.
            low, high = max(0, top - ((slot + 1) << shift) + 1), top - (slot << shift)
            out = []
            for k in range(high >> shift, (low >> shift) - 1, -1):
                if k not in kept:
                    kept[k] = falling.take(k)
                a, b = np.searchsorted(kept[k][0], [low, high + 1])
                own = tuple(x[a:b] for x in kept[k])
                out.append((top - own[0][::-1], own[1][::-1], np.r_[np.uint8(0), own[2][1:][::-1]] if b > a else own[2]))
            for k in [k for k in kept if k > high >> shift]:
                del kept[k]
            return tuple(np.concatenate(x) for x in zip(*out))

        current: list[Tuples] = [nothing()]

        def sources(slot: int) -> Tuples:
            current[0] = fallen(slot)
            return current[0]

        for slot, up in self._sweep(queue, self.rising, lambda s: top - s, sources, None if wide else Carried(self.symbols)):
            down = current[0]
            if slot == queue.slots.n - 1 and not len(up[0]) + len(down[0]) and self.symbols > 1 and not wide:
                continue
            symbols = np.r_[top - down[0][::-1], top - up[0][::-1]]
            places = np.r_[down[1][::-1], up[1][::-1]]
            if wide:
                order = np.argsort(2 * symbols.astype(np.int64) + np.r_[np.zeros(len(down[0]), dtype=np.int64), np.ones(len(up[0]), dtype=np.int64)], kind="stable")
                yield symbols[order], places[order], np.zeros(len(order), dtype=np.uint8)
                continue
            # The common prefix of a suffix with the one before it was told to the one before, which came later.
            values = np.zeros(len(places), dtype=np.uint8)
            d = len(down[0])
            values[1:d] = down[2][1:][::-1]
            if len(up[0]):
                values[d + 1 :] = up[2][1:][::-1]
                if d:
                    values[d] = min(self.run(int(places[d - 1])), self.run(int(places[d])), LONGEST)
            yield symbols, places, values
        queue.slots.close()
        falling.close()
        self.spilled += queue.slots.spilled
        if wide:  # the end alone, which is induced by nothing
            yield np.zeros(1, dtype=np.int32), np.array([len(text) - 1], dtype=np.int32), np.zeros(1, dtype=np.uint8)


def sorted_suffixes(data: np.ndarray, budget: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each first byte the places of its suffixes in order, and their common prefixes with the one before, up to LONGEST."""
    if not len(data):
        return
    text = np.zeros(len(data) + 1, dtype=np.int16)
    text[:-1] = data
    text[:-1] += 1
    wide = np.zeros(len(data) + LONGEST + 15, dtype=np.uint8)
    wide[: len(data)] = data
    view = np.lib.stride_tricks.sliding_window_view(wide, LONGEST)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), dtype=np.uint8)
        for k in range(0, len(a), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            differs = view[x] != view[y]
            n = np.where(differs.any(axis=1), differs.argmax(axis=1), LONGEST)
            out[k : k + 100_000] = np.minimum(n, len(data) - np.maximum(x, y))  # nothing is common beyond the end
        return out

    for _, places, values in Level(text, 257, QUEUE_BYTES if budget is None else budget).suffixes(common):
        if len(places):
            yield places, values
