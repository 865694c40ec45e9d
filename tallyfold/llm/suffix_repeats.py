"""Removal of passages that repeat across documents, by suffix order over shards.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a
smaller key.  Sorting all suffixes of a corpus would shuffle each byte many times over, so
the text is first reduced to where repeats can be, without loss:

1. Every window of LENGTH bytes has an anchor, the GRAM bytes in it with the least hash.
   Equal windows have equal anchors at equal places.
2. Each group of documents deals its different anchors by hash, each once, with the smallest
   and the largest key; those that occur in one document only are dropped.
3. The windows of the other anchors, a stretch of bytes each, are dealt by hash again, equal
   stretches of a group once with their smallest and largest key.  Those of one document whose
   windows lie nowhere else are left out.  The suffixes of the other stretches of a shard
   are put in order with their common prefixes by external induced sorting
   (``induced_sort``); neighbours with a common prefix of LENGTH bytes are equal windows, and
   the smallest key among them says from which documents they go.
4. Each group looks up what its shards say about its occurrences, which never left it.

Texts travel compressed and in groups, so that what is shuffled stays near the size of the
input.  Everything is exact: hashes only decide what is compared.  A passage in very many
documents meets in one shard, but only once for each group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, prepare, slices
from .induced_sort import QUEUE_BYTES, sorted_suffixes
from .shingles import _BASE, _BYTE, _powers, mix

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM + 1
#: Text in a row of the group table, and of what is worked on at once.
GROUP_BYTES, SLICE_BYTES = 16_000_000, 400_000
#: Text behind each bucket of anchors; bytes of all stretches in a shard (the order of their suffixes takes about 25 bytes
#: of memory for each, and queues beyond their budget lie on disk), and of a stretch, about.
BUCKET_BYTES, SHARD_BYTES, STRETCH = 16_000_000, 8_000_000, 66
#: Bytes that anchors are sought in at once; hashes are compared without their lowest PLACE_BITS, where places go.
PIECE, PLACE_BITS = 1 << 22, 24
NO_KEY = np.iinfo(np.int64).max  # a null key comes after all others
U = np.uint64


def pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def anchors(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts lying end to end: hash of each anchor in use, its text's number, and the first and the last start
    of the windows that have it."""
    n = len(data)
    none = np.empty(0, dtype=np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none, none, none
    power, inverse = _powers(max(1 << 21, 1 << n.bit_length()))
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    h = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = U(PLACE_BITS)
    key = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    least, width = key, 1
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if REACH > width:
        least = np.minimum(least[: len(least) - (REACH - width)], least[REACH - width :])
    place = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    valid = np.arange(len(place)) + LENGTH <= ends[owner]
    start = np.flatnonzero(valid)
    if not len(start):
        return none.view(np.uint64), none, none, none
    place, owner = place[start], owner[start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(start)] - 1
    return h[place[new]], owner[new], start[new], start[last]


class Group:
    """Some documents of one task, as a row of the group table."""

    def __init__(self, keys: bytes, sizes: bytes, texts: bytes):
        self.keys, self.sizes, self.data = unpack(keys), unpack(sizes), unpack(texts, np.uint8)

    def anchors(self) -> list[np.ndarray]:
        """As the function of this name, for all texts of the group, slice by slice and long texts piece by piece."""
        ends = np.cumsum(self.sizes)
        parts = []
        for a, b in slices(self.sizes.tolist(), SLICE_BYTES):
            start, end = int(ends[a] - self.sizes[a]), int(ends[b - 1])
            if end - start <= PIECE:
                h, owner, low, high = anchors(self.data[start:end], self.sizes[a:b])
                parts.append((h, owner + a, low + start, high + start))
                continue
            for p in range(start, end, PIECE - LENGTH + 1):  # one long text, or several that end in one; a window lies in one piece
                q = min(p + PIECE, end)
                edges = np.clip(np.r_[start, ends[a:b]], p, q)
                h, owner, low, high = anchors(self.data[p:q], np.diff(edges))
                parts.append((h, owner + a, low + p, high + p))
                if q == end:
                    break
        return [np.concatenate(x) for x in zip(*parts)]

    def bucket_of(self, h: np.ndarray, n: int) -> np.ndarray:
        return (h % U(n)).astype(np.int64)


def grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``gid, rows, keys, sizes, texts``: groups of rows in the order in which they were read, written once."""
    kind = "gid long, keys binary, nulls binary, sizes binary, texts binary"

    def run(batches):
        gid = TaskContext.get().partitionId() << 32
        keys: list = []
        texts: list[bytes] = []
        held = 0

        def out():
            ids = np.array([NO_KEY if k is None else k for k in keys], dtype=np.int64)
            nulls = np.array([k is None for k in keys])
            return pa.RecordBatch.from_arrays(
                [pa.array([gid]), *[pa.array([pack(x)], pa.binary()) for x in (ids, nulls, np.array([len(t) for t in texts], dtype=np.int64), b"".join(texts))]],
                names=["gid", "keys", "nulls", "sizes", "texts"],
            )

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = (t or "").encode()
                if held and held + len(t) > GROUP_BYTES:
                    yield out()
                    gid, keys, texts, held = gid + 1, [], [], 0
                keys.append(k)
                texts.append(t)
                held += len(t)
        if keys:
            yield out()

    return cut(docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, kind), "groups")


def once(h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes in order, the smallest and largest key of each, and which of them each hash is."""
    different, of = np.unique(h, return_inverse=True)
    low, high = np.full(len(different), NO_KEY), np.full(len(different), np.iinfo(np.int64).min)
    np.minimum.at(low, of, keys)
    np.maximum.at(high, of, keys)
    return different, low, high, of


def dealt_anchors(groups: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gid, hashes, low, wide``: the different anchors of each group, by bucket, with the smallest key, and whether another key
    has the anchor too."""
    def run(batches):
        claim(__name__)
        for batch in batches:
            for gid, keys, sizes, texts in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                g = Group(keys, sizes, texts)
                h, owner, _, _ = g.anchors()
                h, low, high, _ = once(h, g.keys[owner])
                b = g.bucket_of(h, buckets)
                order = np.argsort(b, kind="stable")
                edges = np.searchsorted(b[order], np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                parts = [order[edges[k] : edges[k + 1]] for k in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some, pa.int32()), pa.array([gid] * len(some), pa.int64()), pa.array([h[p].tobytes() for p in parts], pa.binary()),
                    *[pa.array([pack(x) for x in made], pa.binary()) for made in ([low[p] for p in parts], [high[p] > low[p] for p in parts])],
                ], names=["bucket", "gid", "hashes", "low", "wide"])

    return groups.select("gid", "keys", "sizes", "texts").mapInArrow(run, "bucket int, gid long, hashes binary, low binary, wide binary")


def shared_anchors(table: pa.Table) -> pa.Table:
    """For the groups of one bucket: bits that say which anchors occur in more than one document."""
    hashes = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    low, wide = (np.concatenate([unpack(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("low", np.int64), ("wide", bool)))
    different, of = np.unique(np.concatenate(hashes), return_inverse=True)
    least, several = np.full(len(different), NO_KEY), np.zeros(len(different), dtype=bool)
    np.minimum.at(least, of, low)
    several[of[wide | (low > least[of])]] = True
    shared = several[of]
    edges = np.cumsum([0] + [len(x) for x in hashes])
    flags = [shared[a:b] for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({
        "gid": table.column("gid"), "bucket": table.column("bucket"),
        "flags": pa.array([np.packbits(f).tobytes() if f.any() else None for f in flags], pa.binary()),
        "n": pa.array([int(f.sum()) for f in flags], pa.int64()),
    })


def stretches(groups: DataFrame, flags: DataFrame, buckets: int, shards: int) -> DataFrame:
    """``shard, gid, numbers, texts, about``: for each group and shard the different stretches of windows under shared anchors
    (``about``: their sizes, smallest and largest keys), and where they occur (``numbers``: stretch, document, key, first byte)."""
    kind = "shard int, gid long, numbers binary, about binary, texts binary"
    by_group = flags.where("flags IS NOT NULL").groupBy("gid").agg(F.collect_list(F.struct("bucket", "flags")).alias("flags"))

    def run(batches):
        claim(__name__)
        for batch in batches:
            for gid, keys, sizes, texts, marked in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                g = Group(keys, sizes, texts)
                h, owner, low, high = g.anchors()
                different, of = np.unique(h, return_inverse=True)
                b = g.bucket_of(different, buckets)
                order = np.argsort(b, kind="stable")
                edges = np.searchsorted(b[order], np.arange(buckets + 1))
                keep = np.zeros(len(different), dtype=bool)
                for m in marked:
                    at = order[edges[m["bucket"]] : edges[m["bucket"] + 1]]
                    keep[at] = np.unpackbits(np.frombuffer(m["flags"], dtype=np.uint8), count=len(at)).astype(bool)
                keep = keep[of]
                h, owner, low, high = h[keep], owner[keep], low[keep], high[keep]
                shard = (mix(h) % U(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                edges = np.searchsorted(shard[order], np.arange(shards + 1))
                size, raw = high - low + LENGTH, g.data.tobytes()
                for s in np.flatnonzero(np.diff(edges)):
                    p = order[edges[s] : edges[s + 1]]
                    seen: dict[bytes, int] = {}
                    alike = np.array([seen.setdefault(raw[x : x + n], len(seen)) for x, n in zip(low[p].tolist(), size[p].tolist())], dtype=np.int64)
                    _, least, most, _ = once(alike, g.keys[owner[p]])
                    about = np.stack([np.array([len(x) for x in seen], dtype=np.int64), least, most])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s], pa.int32()), pa.array([gid]), *[pa.array([pack(x)], pa.binary()) for x in (np.stack([alike, owner[p], g.keys[owner[p]], low[p]]), about, b"".join(seen))],
                    ], names=["shard", "gid", "numbers", "about", "texts"])

    joined = groups.select("gid", "keys", "sizes", "texts").join(by_group, "gid")
    return joined.select("gid", "keys", "sizes", "texts", "flags").mapInArrow(run, kind)


def least_keys(data: np.ndarray, size: np.ndarray, smallest: np.ndarray, budget: int) -> np.ndarray:
    """For each place of stretches that lie end to end the smallest key that the window there occurs with; ``smallest`` are
    the keys of whole stretches.  Places where no window starts get NO_KEY."""
    begin = np.cumsum(size) - size
    stretch = np.repeat(np.arange(len(size), dtype=np.int32), size)
    whole = np.arange(len(data)) - np.repeat(begin, size) <= np.repeat(size - LENGTH, size)
    out = np.full(len(data), NO_KEY)
    for places, common in sorted_suffixes(data, budget):
        at = np.flatnonzero(whole[places])
        if not len(at):
            continue
        new = np.ones(len(at), dtype=bool)
        if len(at) > 1:  # common prefixes across the suffixes between two windows
            new[1:] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) < LENGTH
        starts = np.flatnonzero(new)
        places = places[at]
        found = np.minimum.reduceat(smallest[stretch[places]], starts)
        out[places] = np.repeat(found, np.diff(np.r_[starts, len(places)]))
    return out


def met_again(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of some stretches that lie end to end have a window that lies elsewhere too, by hash: all that do, and hardly another."""
    out, ends, found = np.zeros(len(size), dtype=bool), np.cumsum(size), []
    for a, b in slices(size.tolist(), SLICE_BYTES):
        start = int(ends[a] - size[a])
        h, power, width = _BYTE[data[start : int(ends[b - 1])]], int(_BYTE[255]) | 1, 1
        while width * 2 <= LENGTH:
            h = h[:-width] * U(power) + h[width:]
            power, width = power * power % (1 << 64), width * 2
        h = h[: len(h) - (LENGTH - width)] * U(3) + h[LENGTH - width :]
        begin, windows = ends[a:b] - size[a:b] - start, size[a:b] - (LENGTH - 1)
        found.append(h[np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())])
    found, windows = np.concatenate(found), size - (LENGTH - 1)
    order = np.argsort(found)
    same = np.flatnonzero(found[order[1:]] == found[order[:-1]])
    out[np.searchsorted(np.cumsum(windows), order[np.r_[same, same + 1]], "right")] = True
    return out


def repeated_windows(table: pa.Table, budget: int | None = None) -> pa.Table:
    """For one shard: runs of windows (stretch of the group, first window, end of the last, smallest key) whose smallest key is
    smaller than some key that the stretch has in the group."""
    abouts = [unpack(x).reshape(3, -1) for x in table.column("about").to_pylist()]
    seen: dict[bytes, int] = {}
    of, keys = [], []
    for about, texts in zip(abouts, table.column("texts").to_pylist()):
        raw, ends = zstandard.ZstdDecompressor().decompress(texts), np.cumsum(about[0]).tolist()
        of.append(np.array([seen.setdefault(raw[e - n : e], len(seen)) for e, n in zip(ends, about[0].tolist())], dtype=np.int64))
        keys.append(about[1])
    smallest, largest = np.full(len(seen), NO_KEY), np.full(len(seen), np.iinfo(np.int64).min)
    np.minimum.at(smallest, np.concatenate(of), np.concatenate(keys))
    np.maximum.at(largest, np.concatenate(of), np.concatenate([about[2] for about in abouts]))
    data = np.frombuffer(b"".join(seen), dtype=np.uint8)
    size = np.array([len(x) for x in seen], dtype=np.int64)
    del seen
    # Stretches of one document without a window that lies elsewhere lose nothing, and nothing by them: they need no order.
    kept = (smallest < largest) | met_again(data, size)
    places = np.repeat(kept, size)
    least = np.full(len(data), NO_KEY)
    least[places] = least_keys(data[places], size[kept], smallest[kept], budget)
    begin = np.cumsum(size) - size
    # Runs of windows with one smallest key; the places after a stretch's last window part stretches.
    first = np.flatnonzero((least != NO_KEY) & np.r_[True, least[1:] != least[:-1]])
    last = np.flatnonzero((least != NO_KEY) & np.r_[least[1:] != least[:-1], True])
    owner = np.searchsorted(begin, first, "right") - 1
    edges = np.searchsorted(owner, np.arange(len(size) + 1))
    ids, runs = [], []
    for gid, about, mine in zip(table.column("gid").to_pylist(), abouts, of):
        n = edges[mine + 1] - edges[mine]
        own = np.repeat(np.arange(len(mine)), n)
        run = np.repeat(edges[mine], n) + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        some = least[first[run]] < about[2][own]
        own, run = own[some], run[some]
        if len(own):
            ids.append(gid)
            runs.append(pack(np.stack([own, first[run] - begin[owner[run]], last[run] - begin[owner[run]] + LENGTH, least[first[run]]])))
    return pa.table({"gid": pa.array(ids, pa.int64()), "shard": pa.array([table.column("shard")[0].as_py()] * len(ids), pa.int32()), "runs": pa.array(runs, pa.binary())})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, spans, kept`` for each row: bytes of the text, the removed spans ``[start, end)`` (maximal,
    in order), and the bytes that stay.

    A byte is removed if a string of 50 bytes that covers it also starts in a row with a
    smaller key; rows with equal keys don't remove from each other, and a null key comes after
    all others.  Keys are whole numbers.  A null text is the empty one; texts shorter than 50
    bytes stay whole.  What stays may cut characters, hence bytes.  Repeated rows give equal
    results; other columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    key_type = docs.schema[key].dataType
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("n")).first()["n"] or 0
    buckets = max(16, -(-size // BUCKET_BYTES))
    groups = grouped(docs, key, text)
    flags = cut(dealt_anchors(groups, buckets).groupBy("bucket").applyInArrow(shared_anchors, "gid long, bucket int, flags binary, n long"), "anchor-flags")
    shared = flags.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards, budget = max(16, -(-shared * STRETCH // SHARD_BYTES)), QUEUE_BYTES
    dealt = cut(stretches(groups, flags, buckets, shards), "stretches")

    def sorted_shard(table: pa.Table) -> pa.Table:
        return repeated_windows(table, budget)

    found = cut(dealt.select("shard", "gid", "about", "texts").groupBy("shard").applyInArrow(sorted_shard, "gid long, shard int, runs binary"), "runs")
    runs = dealt.select("gid", "shard", "numbers").join(found, ["gid", "shard"]).groupBy("gid").agg(F.collect_list(F.struct("numbers", "runs")).alias("runs"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([
        T.StructField(key, T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
    ])

    def run(batches):
        claim(__name__)
        for batch in batches:
            for keys, nulls, sizes, texts, marked in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                g = Group(keys, sizes, texts)
                nulls = unpack(nulls, bool)
                edge = np.zeros(len(g.data) + 1, dtype=np.int32)
                for m in marked or []:
                    alike, _, key, low = unpack(m["numbers"]).reshape(4, -1)
                    of, first, end, least = unpack(m["runs"]).reshape(4, -1)
                    # Runs lie by stretch: each occurrence takes those of its stretch whose key is smaller than its own.
                    by = np.searchsorted(of, np.arange(alike.max() + 2))
                    n = by[alike + 1] - by[alike]
                    who = np.repeat(np.arange(len(alike)), n)
                    run = np.repeat(by[alike], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                    goes = least[run] < key[who]
                    who, run = who[goes], run[goes]
                    np.add.at(edge, low[who] + first[run], 1)
                    np.add.at(edge, low[who] + end[run], -1)
                gone = np.cumsum(edge, out=edge)[:-1] > 0
                ends = np.cumsum(g.sizes)
                for a, b in slices(g.sizes.tolist(), SLICE_BYTES):
                    spans, kept = [], []
                    for e, n in zip(ends[a:b], g.sizes[a:b]):
                        own = np.diff(np.r_[0, gone[e - n : e].view(np.int8), 0])
                        spans.append([{"start": int(s), "end": int(t)} for s, t in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
                        kept.append(g.data[e - n : e][~gone[e - n : e]].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.keys[a:b], mask=nulls[a:b]), pa.array(g.sizes[a:b]), pa.array(spans, span), pa.array(kept, pa.binary())], names=schema.names
                    )

    joined = groups.join(runs, "gid", "left").select("keys", "nulls", "sizes", "texts", "runs")
    return joined.mapInArrow(run, schema).withColumn(key, F.col(key).cast(key_type))
