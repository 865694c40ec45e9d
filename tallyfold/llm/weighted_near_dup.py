"""Near-duplicate classes by improved consistent weighted sampling.

Weights.  A shingle of a text weighs its count there times 1 + ln(N / df) / ln N, where
df is the number of the N documents that have it, counted exactly for all shingles.  Texts
are put in slices; a slice's different shingles go out once each, packed by ranges of
hashes, and come back as document counts in the same order.  A shingle of one document
has no other text to be shared with: only its weight is kept.

Signatures.  Improved consistent weighted sampling (Ioffe, 2010) draws for each sample
the shingle with the least a = c / (y e^r), where ln y = r (t - b), t = floor(ln w / r + b),
and keeps the pair (shingle, t); two texts agree in a sample with a chance equal to
their weighted Jaccard similarity.  The draws r, c, b come from a table by the shingle's
hash.  Samples are banded; texts that share a band are compared exactly.

Links.  In each bucket all texts are compared with its first one, and where several
components are left with another one, that differs from bucket to bucket.  Texts that are
still in different components are compared with each other, a pair in the first bucket that
it shares only, which settles the rest; pairs inside one component need no comparison.  An overfull bucket is parted by longer bands
of more samples, which let fewer texts below the threshold meet; before that, texts that
can have no link, because too much of their weight is in shingles that no other text of
the overfull buckets has, are left out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, given_back, pack, pack_texts, prepare, remembers, slices, trim, unpack, unpack_texts
from .components import components
from .shingles import U, distinct_shingles, mix

SIMILARITY = 0.8
#: Bands and samples per band: chance to miss a pair at 0.8 is (1 - 0.8^4)^12 = 0.2 %; in overfull buckets
#: (more than FULL texts) (1 - 0.8^10)^60 = 0.11 %.
BANDS, ROWS = 12, 4
FINE_BANDS, FINE_ROWS, FULL = 60, 10, 48
#: Bytes of text in a slice, of what is worked on at once, and about so many shingles in a range of hashes.
SLICE_BYTES, PART_BYTES, RANGE = 3_000_000, 150_000, 1_000_000
LEVELS, STEP = 32, 0.2
BROADCAST_ROWS = 500_000


# --- document frequencies ------------------------------------------------------------------------

class Weights:
    """Shingle weights from document counts; a shingle without a count has one document."""

    def __init__(self, n: int, hashes: np.ndarray = (), df: np.ndarray = ()):
        self.n, self.hashes, self.df = n, hashes, df

    def by_count(self, df: np.ndarray, times: np.ndarray) -> np.ndarray:
        return (1 + np.log(max(self.n, 1) / df) / np.log(max(self.n, 2))) * times

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        df = np.ones(len(h))
        if len(self.hashes) and len(h):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[at] == h
            df[same] = self.df[at[same]]
        return self.by_count(df, times)


def text_slices(own: DataFrame) -> DataFrame:
    """``slice, nodes, sizes, texts``: the rows (``text, node``) in slices of about SLICE_BYTES, packed, without empty texts."""
    prepare(own.sparkSession)

    def run(batches):
        claim(__name__)
        number, nodes, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            sizes = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b"".join(nodes)], pa.binary()), sizes, pa.array([pack_texts(texts)], pa.binary())], names=["slice", "nodes", "sizes", "texts"])

        for batch in batches:
            for text, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                nodes.append(node)
                texts.append(text.encode())
                size += len(texts[-1])
                if size > SLICE_BYTES:
                    yield out()
                    number, nodes, texts, size = number + 1, [], [], 0
        if texts:
            yield out()

    return cut(own.select("text", "node").mapInArrow(given_back(run), "slice long, nodes binary, sizes array<long>, texts binary"), "slices")


def shingle_parts(texts: list[bytes]) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, *distinct_shingles(texts[a:b]))`` for a few texts at a time, which bounds what is held while they are made."""
    return [(a, b, *distinct_shingles(texts[a:b])) for a, b in slices([len(x) for x in texts], PART_BYTES)]


def document_counts(sliced: DataFrame, size: int) -> DataFrame:
    """``slice, found``: for each slice the document counts of its different shingles by ascending hash, packed range by range."""
    bits = max(0, math.ceil(math.log2(max(size / 6 / RANGE, 1))))

    def dealt(batches):
        claim(__name__)
        for batch in batches:
            for number, sizes, texts in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                trim()
                h, k = np.unique(np.concatenate([part[2] for part in shingle_parts(unpack_texts(sizes, texts))]), return_counts=True)
                place = (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
                ranges, first = np.unique(place, return_index=True)
                ends = np.r_[first[1:], len(h)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(ranges), pa.int64()), pa.array(ranges, pa.int64()),
                    pa.array([pack(np.diff(h[a:b], prepend=U(0))) for a, b in zip(first, ends)], pa.binary()), pa.array([pack(k[a:b].astype("<u4")) for a, b in zip(first, ends)], pa.binary()),
                ], names=["slice", "range", "hashes", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        claim(__name__)
        hashes = [np.cumsum(unpack(x, U), dtype=U) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([unpack(x, "<u4") for x in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        df = np.bincount(at, weights=counts)[at].astype("<u4")
        parts = [pack(x) for x in np.split(df, np.cumsum([len(x) for x in hashes])[:-1])]
        return pa.table({"slice": table.column("slice"), "range": table.column("range"), "df": pa.array(parts, pa.binary())})

    packed = sliced.select("slice", "sizes", "texts").mapInArrow(given_back(dealt), "slice long, range long, hashes binary, counts binary")
    counted = packed.groupBy("range").applyInArrow(summed, "slice long, range long, df binary")
    return counted.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("range", "df"))).alias("found"))


# --- signatures ----------------------------------------------------------------------------------

@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """For each level of ln w and each of 2^16 draws (r, c, b): an order-preserving code of ln a with draw and
    level below it, and t."""
    rng = np.random.default_rng(97)
    r, c, b = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.uniform(0, 1, 1 << 16)
    codes, steps = np.empty((LEVELS, 1 << 16), dtype=np.uint64), np.empty((LEVELS, 1 << 16), dtype=np.int32)
    draw = np.arange(1 << 16, dtype=np.uint64) << U(16)
    for k in range(LEVELS):  # one after the other, which holds little besides the result
        t = np.floor(k * STEP / r + b)
        code = (np.log(c) - r * (t - b) - r).astype(np.float32).view(np.uint32)
        code = np.where(code >> 31, ~code, code | np.uint32(1 << 31)).astype(np.uint64)
        codes[k], steps[k] = code << U(32) | draw | U(k << 11), t
    return codes.ravel(), steps.ravel()


def _forget() -> None:
    _draws.cache_clear()


remembers(__name__, _forget)


@lru_cache(2)
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def samples(h: np.ndarray, weights: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n samples of each text (all texts have shingles): numbers that agree where (shingle, t) does."""
    table, t = _draws()
    level = np.clip(np.rint(np.log(weights) / STEP), 0, LEVELS - 1).astype(np.uint64) << U(16)
    own = h & U(0x7FF)
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    out = np.empty((n, len(counts)), dtype=np.uint64)
    for d, factor in enumerate(_factors(FINE_BANDS * FINE_ROWS)[:n]):
        keys = table[level | (h * factor >> U(48))] | own
        best = np.minimum.reduceat(keys, starts) & U(0xFFFFFFFF)
        draw, at = best >> U(16), (best >> U(11)) & U(LEVELS - 1)
        step = t[(at << U(16) | draw).astype(np.int64)].astype(np.int64).view(np.uint64)
        out[d] = mix((draw << U(11) | (best & U(0x7FF))) + (step << U(32)) + U(d * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out.T


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band of each text."""
    keys = found.reshape(len(found), bands, rows)
    out = keys[:, :, 0].copy()
    for k in range(1, rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + keys[:, :, k])
    return out


def signed_vectors(own: DataFrame, n: int, size: int) -> DataFrame:
    """For the rows (``text, node``) that have a shingle: ``node``, its band ``keys``, ``hashes`` and ``weights`` of its
    shingles in more than one document as packed numbers, ``single``, the weight of its other shingles, and its ``total`` weight."""
    weights = Weights(n)
    sliced = text_slices(own)

    def run(batches):
        claim(__name__)
        for batch in batches:
            for nodes, sizes, texts, found in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                trim()
                texts = unpack_texts(sizes, texts)
                nodes = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
                counts_of = np.concatenate([unpack(x["df"], "<u4") for x in found] or [np.empty(0, "<u4")])
                parts = shingle_parts(texts)
                listed = np.unique(np.concatenate([part[2] for part in parts]))
                for a, _, h, times, counts in parts:
                    some = np.flatnonzero(counts)
                    if not len(some):
                        continue
                    df = counts_of[np.searchsorted(listed, h)]
                    w = weights.by_count(df, times)
                    counts = counts[some]
                    keys = band_keys(samples(h, w, counts, BANDS * ROWS), BANDS, ROWS).view(np.int64)
                    starts = np.cumsum(counts) - counts
                    shared = df > 1
                    ends = np.cumsum(np.add.reduceat(shared.astype(np.int64), starts))
                    begins = np.r_[0, ends[:-1]]
                    hs, ws = h[shared], w[shared]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([nodes[a + i] for i in some], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
                        pa.array([hs[x:y].tobytes() for x, y in zip(begins, ends)], pa.binary()), pa.array([ws[x:y].tobytes() for x, y in zip(begins, ends)], pa.binary()),
                        pa.array(np.add.reduceat(np.where(shared, 0.0, w), starts)), pa.array(np.add.reduceat(w, starts)),
                    ], names=["node", "keys", "hashes", "weights", "single", "total"])

    joined = sliced.join(document_counts(sliced, size), "slice").select("nodes", "sizes", "texts", "found")
    return cut(joined.mapInArrow(given_back(run, _forget), "node binary, keys array<long>, hashes binary, weights binary, single double, total double"), "signed-vectors")


def fine_signatures(texts: DataFrame, n: int) -> DataFrame:
    """``node, keys`` by FINE_BANDS for the rows (``text, node, hashes, weights``)."""
    weights = Weights(n)

    def run(batches):
        claim(__name__)
        for batch in batches:
            for text, node, hashes, known in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                h, times, counts = distinct_shingles([text.encode()])
                w = weights.of(h, times)
                w[np.searchsorted(h, np.frombuffer(hashes, U))] = np.frombuffer(known)
                keys = band_keys(samples(h, w, counts, FINE_BANDS * FINE_ROWS), FINE_BANDS, FINE_ROWS).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([keys.ravel()], pa.list_(pa.int64()))], names=["node", "keys"])

    return texts.select("text", "node", "hashes", "weights").mapInArrow(given_back(run, _forget), "node binary, keys array<long>")


# --- exact comparison ----------------------------------------------------------------------------

def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray, total: float | None = None) -> float:
    """Sum of smaller weights over sum of larger ones; hashes are ascending.  ``total`` is both texts' weight where
    not all shingles are given."""
    total = w1.sum() + w2.sum() if total is None else total
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    same = h2[at] == h1
    least = np.minimum(w1[same], w2[at[same]]).sum()
    return float(least / (total - least))


def verified(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a, b`` that are similar enough."""
    left = known.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"), F.col("total").alias("ta"))
    right = known.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"), F.col("total").alias("tb"))

    def run(batches):
        for batch in batches:
            keep = [
                weighted_jaccard(np.frombuffer(ha, U), np.frombuffer(wa), np.frombuffer(hb, U), np.frombuffer(wb), total) >= similarity - 1e-9
                for ha, wa, hb, wb, total in zip(*[batch.column(k).to_pylist() for k in range(2, 7)])
            ]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb", (F.col("ta") + F.col("tb")).alias("total"))
    return both.mapInArrow(given_back(run), "a binary, b binary")


def lone_weights(known: DataFrame) -> DataFrame:
    """``node, lone``: weight of the shingles, of those listed, that no other text of ``known`` has."""

    def run(batches):
        for batch in batches:  # shingles of a batch meet here first: one row each, with how many texts have it
            hashes = [np.frombuffer(x, U) for x in batch.column(1).to_pylist()]
            w = np.concatenate([np.frombuffer(x) for x in batch.column(2).to_pylist()] or [np.empty(0)])
            flat = np.concatenate(hashes or [np.empty(0, U)])
            owner = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
            h, first, n = np.unique(flat, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner[first])), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(w[first])], names=["node", "h", "n", "w"]
            )

    rows = known.select("node", "hashes", "weights").mapInArrow(run, "node binary, h long, n long, w double")
    once = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("node").alias("node"), F.max("w").alias("w")).where("n = 1")
    return once.groupBy("node").agg(F.sum("w").alias("lone"))


def linkable(known: DataFrame, similarity: float, rounds: int = 3) -> DataFrame:
    """``known`` with ``lone``, less texts that no other text can be similar to: a pair shares none of either
    one's lone weight, so a text with over 1 - similarity of its weight alone has no link.  Leaving such texts
    out makes more shingles lone, hence the rounds."""
    for _ in range(rounds):
        n = known.count()
        lone = lone_weights(known)
        known = cut(known.drop("lone").join(lone, "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0.0)) + F.col("single")).where(F.col("lone") <= (1 - similarity) * F.col("total") + 1e-9), "linkable")
        if known.count() == n:
            break
    return known


# --- classes -------------------------------------------------------------------------------------

def _members(signed: DataFrame, first: str | None = None) -> DataFrame:
    """``node, band, key, n, pivot`` of the texts that share a bucket with another; the pivot is the text with
    the smallest ``first`` (a column of ``signed``) and then node."""
    rank = [first] if first else []
    rows = signed.select("node", *rank, F.posexplode("keys").alias("band", "key"))
    least = F.min(F.struct(*rank, "node")).getField("node")
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n"), least.alias("pivot")).where("n > 1")
    rows = rows.drop(*rank)
    return rows.join(shared, ["band", "key"])


def _of(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the table whose node is listed; the list is broadcast only if it is counted and small."""
    return table.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "node", "left_semi")


def _labelled(own: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows with ``node`` (a key of the text), and ``node, label`` of texts that are linked to others."""
    own = own.withColumn("node", F.unhex(F.md5("text")))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    every = signed_vectors(own, n, size)
    signed = cut(every.groupBy("node").agg(F.first("keys").alias("keys")), "signatures")

    def vectors(nodes: DataFrame) -> DataFrame:
        fields = ["hashes", "weights", "single", "total"]
        return _of(every, nodes).groupBy("node").agg(F.first(F.struct(*fields)).alias("x")).select("node", "x.*")

    members = cut(_members(signed), "members")
    hot = cut(members.where(F.col("n") > FULL).select("node").distinct(), "hot")
    members = members.where(F.col("n") <= FULL).drop("n")
    bounds = None
    if not hot.isEmpty():
        one_each = cut(_of(own, hot).groupBy("node").agg(F.first("text").alias("text")), "hot-texts")
        able = linkable(cut(vectors(hot), "hot-vectors"), similarity)
        bounds = able.select("node", "lone")
        fine_signed = fine_signatures(one_each.join(able.select("node", "hashes", "weights"), "node"), n)
        fine = _members(fine_signed.join(bounds, "node"), "lone").withColumn("band", F.col("band") + BANDS).drop("n")
        members = cut(members.unionByName(fine.select(*members.columns)), "fine-members")
    nodes = cut(members.select("node").distinct(), "nodes")
    known = cut(vectors(nodes), "vectors")
    size = known.select("node", "total")
    size = size.join(bounds, "node", "left") if bounds is not None else size.withColumn("lone", F.lit(None).cast("double"))

    def linked(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        found = cut(verified(pairs, known, similarity), "links")
        if links is not None:
            found = cut(links.unionByName(found), "links") if not found.isEmpty() else links
        return found, cut(components(found), "labels")

    def still_apart(labels: DataFrame) -> DataFrame:
        placed = members.select("band", "key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = placed.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band", "key")
        return placed.join(mixed, ["band", "key"])

    pair = [F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")]
    stars = cut(members.where("node <> pivot").select(*pair).distinct(), "stars")
    links, labels = linked(stars, None)
    apart = cut(still_apart(labels), "apart")
    if not apart.isEmpty():  # once more, with another text of each such bucket
        other = apart.groupBy("band", "key").agg(F.max_by(F.struct("node", "label"), F.xxhash64("band", "key", "node")).alias("p"))
        again = apart.join(other, ["band", "key"]).where("label <> p.label").select("node", F.col("p.node").alias("pivot")).select(*pair).distinct()
        links, labels = linked(again.join(stars, ["a", "b"], "left_anti"), links)
        # Buckets that still hold several components: their texts are compared across components, where the
        # weights allow a link (lone weights hold for the fine buckets, whose texts are all from one set).
        apart = still_apart(labels)
        bands = F.map_from_entries(F.collect_list(F.struct("band", "key")))
        own_keys = apart.groupBy("node").agg(bands.alias("at")).select("node", F.transform(F.sequence(F.lit(0), F.lit(BANDS + FINE_BANDS - 1)), lambda k: F.try_element_at("at", k)).alias("keys"))
        lone = F.when(F.col("band") >= BANDS, F.col("lone")).otherwise(0.0)
        apart = cut(apart.join(size, "node").join(own_keys, "node").withColumn("lone", F.coalesce(lone, F.lit(0.0))), "apart")
        right = apart.select("band", "key", F.col("node").alias("b"), F.col("label").alias("other"), F.col("total").alias("total_b"), F.col("lone").alias("lone_b"), F.col("keys").alias("keys_b"))
        most = F.least(F.col("total") - F.col("lone"), F.col("total_b") - F.col("lone_b")) / F.greatest(F.col("total") + F.col("lone_b"), F.col("total_b") + F.col("lone"))
        first = F.array_position(F.zip_with("keys", "keys_b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(True)) == F.col("l.band") + 1
        across = (
            apart.alias("l").join(right.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.key") == F.col("r.key")) & (F.col("label") < F.col("other")) & (most >= similarity - 1e-9) & first)
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        )
        links, labels = linked(across.join(stars, ["a", "b"], "left_anti"), links)

    return own, labels


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``key``, ``class_id`` (the smallest key in the class) and ``class_size`` (rows) for each row of ``docs``.

    Texts are in one class if a chain of links joins them; a link is a weighted Jaccard
    similarity of ``similarity`` or more.  Equal texts with a word are in one class.  Rows
    without any word (null, empty, blank) are each in a class of their own, with their own
    key as its id; null keys come after others and stand in only where a class has no other.
    Repeated rows get equal results.  Other columns are left out; an empty table gives an
    empty result.
    """
    own, labels = _labelled(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), similarity)
    blank = F.coalesce(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0, F.lit(True))
    rows = own.select("key", "node", blank.alias("blank")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spoken = rows.where("NOT blank")
    sizes = spoken.groupBy("label").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    classed = spoken.select("key", "label").join(sizes, "label").select("key", "class_id", "class_size")
    return classed.unionByName(rows.where("blank").select("key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"))).withColumnRenamed("key", key)


def keep_one_of_each_class(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one of each class: that with the smallest key stays (of equal keys the
    smallest text's; of repeated rows one).  Rows without a word all stay.  Columns stay as they are, whatever their names."""
    safe = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    kept = _keep_one(docs.toDF(*safe.values()), safe[key], safe[text], similarity)
    return kept.select(*[F.col(s).alias(c) for c, s in safe.items()])


def _keep_one(docs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The same for columns whose names no step uses."""
    _, labels = _labelled(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), similarity)
    body = F.col(text).cast("string")
    own = docs.withColumn("__node", F.unhex(F.md5(body)))
    spoken = F.coalesce(F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")) > 0, F.lit(False))
    # Rows of one text and key, then texts, then classes: only keys are shuffled to find what stays.
    rows = own.where(spoken).groupBy(F.col("__node").alias("node"), F.col(key).alias("first")).agg(F.count("*").alias("same"))
    order = F.struct(F.col("first").isNull(), "first")
    texts = rows.groupBy("node").agg(F.min_by(F.struct("first", "same"), order).alias("x")).select("node", "x.first", "x.same")
    classed = texts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = F.min_by(F.struct("node", "first", "same"), F.struct(F.col("first").isNull(), "first", "node"))
    kept = cut(classed.groupBy("label").agg(best.alias("x")).select(F.col("x.node").alias("__kept"), F.col("x.first").alias("__first"), F.col("x.same").alias("__same")), "kept")
    stay = own.where(spoken).join(kept, (F.col("__node") == F.col("__kept")) & F.col(key).eqNullSafe(F.col("__first")))
    if not kept.where("__same > 1").isEmpty():  # rows that repeat both key and text: one of them stays
        stay = stay.dropDuplicates(["__node"])
    return stay.select(*docs.columns).unionByName(own.where(~spoken).select(*docs.columns))
