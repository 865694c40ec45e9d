"""How far the sources of a language diverge in their words, exactly.

A CountVectorizer with a least document frequency and the largest possible vocabulary makes exact
sparse vectors of documents.  A term is known to it by its language and itself, so that one fit serves
all languages and document frequencies are those within a language.  The vocabulary passes through the
driver: terms are dealt by hash into as many pieces as are needed for PIECE_TERMS each, fitted one
after the other; their number comes from a count of kept terms in a 64th of the hashes, over all rows.

It is fitted on the different terms of each document.  For the sums, the terms of a task's documents are
gathered by (language, source) before they become vectors: a term that occurs n times there is in a bag for each
binary digit of n that is one, and a bag's vector counts for that power of two.  So a vector has few entries
however often a term is said.  The vectors are summed by (language, source) in sparse form within tasks; the sums are
packed by blocks of the vocabulary, and each block's are added by one task, one after the other.  Pairs of sources are
compared in tiles: a block of sources against a block of sources on a block of terms, so that a task holds
two blocks of sources at most, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, cut, given_back, pack, prepare, trim, unpack
from .shingles import _BYTE, U, mix

#: What each UTF-8 byte is in a term, 0 for bytes of no term: letters (A to Z lower-cased) and all beyond ASCII.
IN_TERM = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], dtype=np.uint8)
SCALE = 1_000_000_000
LARGEST_VOCABULARY = 2**31 - 1
#: Terms of all languages that are fitted together; about 200 bytes each on the driver and on each executor.
PIECE_TERMS = 1_000_000
SAMPLED = 64
#: Sources and terms of a tile's side (about so many: they are dealt by hash).
BLOCK_SOURCES, BLOCK_TERMS = 128, 4096
#: Sums of (group, term) that a task holds before it hands them on, and terms of a block of sums, as a power of two.
HELD, BLOCK_BITS = 1_000_000, 14


def led_terms(langs: list[str], texts: pa.Array) -> pa.ListArray:
    """The terms of each text, in order, each led by the text's language and a zero byte.

    A term is a run of letters and of characters beyond ASCII; only A to Z are lower-cased.
    """
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = IN_TERM[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]]
    edges -= edges[0]
    inside = np.r_[False, data != 0, False]
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    inner = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]  # no term goes from one text into the next
    begin[inner] |= data[inner] != 0
    end[inner - 1] |= data[inner - 1] != 0
    starts, length = np.flatnonzero(begin), np.flatnonzero(end) + 1
    length -= starts
    first: dict[str, int] = {}
    per_text = np.diff(np.searchsorted(starts, edges))
    of = np.repeat(np.array([first.setdefault(x, k) for k, x in enumerate(langs)], dtype=np.int64), per_text)
    lead = {k: np.frombuffer(langs[k].encode() + b"\0", dtype=np.uint8) for k in set(of.tolist())}
    led = np.array([len(lead[k]) if k in lead else 0 for k in range(len(langs))], dtype=np.int64)[of]
    upto = np.r_[0, np.cumsum(length + led)]
    out = np.empty(upto[-1], dtype=np.uint8)
    out[np.arange(length.sum()) + np.repeat(np.cumsum(led), length)] = data[data != 0]
    for k, name in lead.items():
        out[upto[:-1][of == k][:, None] + np.arange(len(name))] = name
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(out))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32)), words)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """A list for each of n owners, in whose order the values lie."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _drawn(words: pa.StringArray, sampled: int) -> np.ndarray:
    """Whether each word (none is empty) is one of those drawn, one in ``sampled`` by a hash of its bytes in any order."""
    if not len(words):
        return np.zeros(0, dtype=bool)
    edges = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[: edges[-1]]
    return mix(np.add.reduceat(_BYTE[data], edges[:-1])) % U(sampled) == 0


_LOW = 0xFFFFFFFF
_TERM_ROWS = "lang string, source string, terms array<string>, some array<string>, bag array<string>, power int"


def _rows_of_terms(batches, sampled: int):
    """A row for each document: its different ``terms``, and ``some`` of them, one in ``sampled`` by hash.  Then rows for groups
    of documents, in which a ``bag`` has terms that are to count 2^power times."""
    claim(__name__)
    names = ["lang", "source", "terms", "some", "bag", "power"]
    none = lambda n: pa.nulls(n, pa.list_(pa.string()))
    groups: dict[tuple, int] = {}
    waiting: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def bags():
        coded = pa.concat_arrays([w for _, w, _ in waiting]).dictionary_encode()
        keys = np.concatenate([g for g, _, _ in waiting]) << 32 | coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(keys, kind="stable")
        once, _ = _counted(keys)
        n = np.add.reduceat(np.concatenate([n for _, _, n in waiting])[order], np.searchsorted(keys[order], once)) if len(once) else np.zeros(0, np.int64)
        lang, source = (pa.array([x[k] for x in groups], pa.string()) for k in (0, 1))
        for power in range(int(n.max(initial=0)).bit_length()):
            here = once[(n >> power & 1) == 1]
            of, _ = _counted(here >> 32)
            lists = _lists(np.searchsorted(of, here >> 32), len(of), coded.dictionary.take(pa.array(here & _LOW)))
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), none(len(of)), none(len(of)), lists, pa.array([power] * len(of), pa.int32())], names=names)
        waiting.clear()
        groups.clear()
        trim()

    for batch in batches:
        lang, source, text = batch.columns
        listed = led_terms(lang.to_pylist(), text)
        coded, rows = listed.values.dictionary_encode(), len(text)
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        of = np.repeat(np.arange(rows), np.diff(listed.offsets.to_numpy()))
        each, _ = _counted(of << 32 | code)
        own, mine = each >> 32, each & _LOW
        drawn = _drawn(words, sampled)[mine]
        yield pa.RecordBatch.from_arrays([lang, source, _lists(own, rows, words.take(pa.array(mine))), _lists(own[drawn], rows, words.take(pa.array(mine[drawn]))), none(rows), pa.nulls(rows, pa.int32())], names=names)
        group = np.array([groups.setdefault(x, len(groups)) for x in zip(lang.to_pylist(), source.to_pylist())], dtype=np.int64)
        each, n = _counted(group[of] << 32 | code)
        waiting.append((each >> 32, words.take(pa.array(each & _LOW)), n))
        if sum(len(n) for _, _, n in waiting) > HELD:
            yield from bags()
    if waiting:
        yield from bags()


def term_rows(docs: DataFrame) -> DataFrame:
    """Of ``lang, source, text``: rows of documents and rows of bags, see :func:`_rows_of_terms`."""
    sampled = SAMPLED
    return docs.select("lang", "source", "text").mapInArrow(given_back(lambda batches: _rows_of_terms(batches, sampled)), _TERM_ROWS)


def _bucket(value: Column, n: Column | int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(value), 16), n if isinstance(n, Column) else F.lit(n))


def _dealt_to(piece: int, pieces: int) -> Callable[[Column], Column]:
    return lambda term: _bucket(term, pieces) == piece


def _sums(batches):
    """Sparse sums of vectors by language and source, packed by blocks of the vocabulary, of bounded size; for mapInArrow."""
    claim(__name__)
    codes: dict[tuple, int] = {}
    keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        once, at = np.unique(np.concatenate([keys, *[k for k, _ in waiting]]), return_inverse=True)
        added = np.zeros(len(once), dtype=np.int64)
        np.add.at(added, at, np.concatenate([values, *[v for _, v in waiting]]))
        return once, added

    def rows():
        names, (blocks, sizes) = list(codes), _counted(keys >> BLOCK_BITS)
        ends = np.cumsum(sizes)
        for a in range(0, len(blocks), 1000):
            some = blocks[a : a + 1000]
            of = (some >> 32 - BLOCK_BITS).tolist()
            parts = [slice(e - k, e) for e, k in zip(ends[a : a + 1000].tolist(), sizes[a : a + 1000].tolist())]
            places = [pack(np.diff(keys[p] & (1 << BLOCK_BITS) - 1, prepend=0).astype("<u4")) for p in parts]
            yield pa.RecordBatch.from_arrays([
                *[pa.array([names[g][k] for g in of], pa.string()) for k in (0, 1)], pa.array(some & (1 << 32 - BLOCK_BITS) - 1),
                pa.array(places, pa.binary()), pa.array([pack(values[p]) for p in parts], pa.binary()),
            ], names=["lang", "source", "block", "places", "n"])

    for batch in batches:
        lang, source, power, vectors = batch.columns
        index, number = vectors.field("indices"), vectors.field("values")
        lengths = np.diff(index.offsets.to_numpy())
        group = np.array([codes.setdefault(x, len(codes)) for x in zip(lang.to_pylist(), source.to_pylist())], dtype=np.int64)
        times = number.flatten().to_numpy().astype(np.int64) << np.repeat(power.to_numpy().astype(np.int64), lengths)
        waiting.append((np.repeat(group << 32, lengths) | index.flatten().to_numpy().astype(np.int64), times))
        if sum(len(k) for k, _ in waiting) > HELD:
            keys, values = merged()
            waiting.clear()
            if len(keys) > HELD:
                yield from rows()
                keys, values = keys[:0], values[:0]
                codes.clear()
    if waiting:
        keys, values = merged()
    yield from rows()


def _added(batches, first: int):
    """Sums ``lang, source, id, n`` of packed ones that come block by block; one block is held at a time.  Ids count from ``first``."""
    claim(__name__)
    now, total = None, np.zeros(1 << BLOCK_BITS, dtype=np.int64)

    def out():
        some = np.flatnonzero(total)
        lang, source, block = now
        return pa.RecordBatch.from_arrays([
            *[pa.repeat(pa.scalar(x, pa.string()), len(some)) for x in (lang, source)], pa.array(some + first + (block << BLOCK_BITS)), pa.array(total[some]),
        ], names=["lang", "source", "id", "n"])

    for batch in batches:
        for *key, places, n in zip(*[c.to_pylist() for c in batch.columns]):
            if key != now:
                if now:
                    yield out()
                now = key
                total[:] = 0
            total[np.cumsum(unpack(places, "<u4"), dtype=np.int64)] += unpack(n, np.int64)
    if now:
        yield out()


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Summed differences of all pairs of sources of a tile, less what they would be if no term here occurred."""
    sid, block, term, p = (table[c].to_numpy() for c in ("sid", "block", "id", "p"))
    head = term < 0
    order = np.argsort(sid[head])
    source, side, base = sid[head][order], block[head][order], p[head][order]
    names, column = np.unique(term[~head], return_inverse=True)
    shares = np.repeat(base[:, None], max(1, len(names)), axis=1)
    shares[np.searchsorted(source, sid[~head]), column] = p[~head]
    out = []
    both = key[1].as_py() != key[2].as_py()
    for k in range(len(source) - 1):
        others = slice(k + 1, None)
        far = np.abs(shares[others] - shares[k]).sum(axis=1) - shares.shape[1] * np.abs(base[others] - base[k])
        take = side[others] != side[k] if both else np.ones(len(far), dtype=bool)
        out.append((np.full(take.sum(), source[k]), source[others][take], far[take]))
    x, y, far = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"x": x, "y": y, "far": far})


def vocabulary_and_sums(rows: DataFrame, min_df: int) -> tuple[DataFrame, DataFrame]:
    """Of :func:`term_rows` (terms led by language and a zero): the kept terms ``id, lang, term`` and their
    occurrences ``lang, source, id, n`` in each group."""
    spark = rows.sparkSession
    kept = rows.select(F.explode("some").alias("t")).groupBy("t").count().where(F.col("count") >= min_df).count()
    pieces = 1 + kept * SAMPLED // PIECE_TERMS
    count_vectors = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=LARGEST_VOCABULARY)
    words = spark.createDataFrame([], "id long, lang string, term string")
    sums = spark.createDataFrame([], "lang string, source string, id long, n long")
    bags = rows.where("bag IS NOT NULL").select("lang", "source", "power", F.col("bag").alias("terms"))
    for piece in range(pieces):
        each, bagged = (x if pieces == 1 else x.withColumn("terms", F.filter("terms", _dealt_to(piece, pieces))) for x in (rows.where("terms IS NOT NULL").select("terms"), bags))
        try:
            model = count_vectors.fit(each)
        except IllegalArgumentException as e:
            if "vocabulary size should be > 0" not in str(e):
                raise
            continue
        first = piece << 32
        names = spark.createDataFrame(pa.table({"id": pa.array(range(first, first + len(model.vocabulary)), pa.int64()), "both": pa.array(model.vocabulary)}))
        term = F.substring_index("both", "\0", -1)
        words = words.unionByName(cut(names.select("id", F.substring("both", F.lit(1), F.length("both") - F.length(term) - 1).alias("lang"), term.alias("term")), "vocabulary"))
        vectors = model.transform(bagged).select("lang", "source", "power", "vector")
        part = vectors.mapInArrow(given_back(_sums), "lang string, source string, block long, places binary, n binary")
        by_block = part.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block")
        sums = sums.unionByName(cut(by_block.mapInArrow(lambda batches, first=first: _added(batches, first), "lang string, source string, id long, n long"), "sums"))
    return words, sums


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 5) / (total + 5 v)), exact; null where nothing is kept."""
    above = F.lit(SCALE).cast("decimal(12,0)") * (n + 5).cast("decimal(20,0)")
    return F.when(v > 0, 1 + F.call_function("div", above, (total + 5 * v).cast("decimal(20,0)")))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_df: int = 30, top: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every pair of language and source that occurs.

    Terms in ``min_df`` documents of a language or more are kept; a group's share of one is
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)), with its n occurrences among N of the V kept terms.  Part
    ``pair``: each other source of the language and the sum of the shares' differences over all kept
    terms (0 where none is kept).  Part ``term``: the ``top`` terms that the group has and whose share is above
    the language's, with the difference.  Ranks fall by value, ties go by UTF-8 order of the item.
    Null language, source or text is the empty one.  Equal rows count each.  No rows give no rows.
    """
    prepare(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = cut(term_rows(plain), "terms")
    words, sums = vocabulary_and_sums(rows, min_df)

    size = words.groupBy("lang").agg(F.count("*").alias("v"))
    within = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(within, ["lang", "source"], "left").join(size, "lang", "left")
    groups = cut(groups.select("lang", "source", F.monotonically_increasing_id().alias("sid"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    entries = cut(sums.join(groups, ["lang", "source"]).select("sid", "id", _share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "shares")

    overall = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    usual = words.join(sums.groupBy("id").agg(F.sum("n").alias("n")), "id").join(overall, "lang").select("id", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    above = entries.join(usual, "id").where("p > q").select("sid", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("sid").orderBy(F.col("value").desc(), "item")
    best = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    pairs = _pairs(entries, groups).join(groups.select(F.col("sid").alias("other"), F.col("source").alias("item")), "other")
    ranked = pairs.select("sid", "item", "value").withColumn("rank", F.row_number().over(by_value))
    both = ranked.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    return both.join(groups.select("sid", "lang", "source"), "sid").select("lang", "source", "part", "item", "value", "rank")


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """``sid, other, value`` for all pairs of sources of a language, in both directions."""
    shape = groups.groupBy("lang").agg(F.min("sid").alias("area"), F.ceil(F.count("*") / BLOCK_SOURCES).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.max("v") / BLOCK_TERMS)).alias("stripes"))
    base = F.coalesce(_share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)).cast("long")
    placed = cut(groups.join(shape, "lang").select("sid", "area", "blocks", "stripes", "v", base.alias("base"), _bucket(F.col("sid"), F.col("blocks")).alias("block")), "blocks")
    heads = placed.select("sid", "area", "blocks", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("stripe"), F.lit(-1).cast("long").alias("id"), F.col("base").alias("p"))
    cells = entries.join(placed, "sid").select("sid", "area", "blocks", "block", _bucket(F.col("id"), F.col("stripes")).alias("stripe"), "id", "p")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("facing")
    dealt = heads.unionByName(cells).select("sid", "area", "block", "stripe", "id", "p", other)
    dealt = dealt.select("area", F.least("block", "facing").alias("a"), F.greatest("block", "facing").alias("b"), "stripe", "sid", "block", "id", "p")
    tiles = dealt.groupBy("area", "a", "b", "stripe").applyInArrow(_tile, "x long, y long, far long")
    summed = tiles.groupBy("x", "y").agg(F.sum("far").alias("far"))
    side = lambda name: placed.select(F.col("sid").alias(name), F.col("base").alias(f"base_{name}"), *(["v"] if name == "x" else []))
    value = F.col("far") + F.col("v") * F.abs(F.col("base_x") - F.col("base_y"))
    once = cut(summed.join(side("x"), "x").join(side("y"), "y").select("x", "y", value.alias("value")), "pairs")
    return once.select(F.col("x").alias("sid"), F.col("y").alias("other"), "value").unionByName(once.select(F.col("y").alias("sid"), F.col("x").alias("other"), "value"))
