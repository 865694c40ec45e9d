"""Line deduplication by a log-template tree of fixed depth.

A line's path in the tree is its token count and its leading tokens, where a token with
a digit stands for any value.  Inside a leaf, lines join the template that they share
most tokens with; tokens in which they differ become variable fields.  Templates that
recur in enough documents are dropped from all documents but the first.

Only hashes of lines are shuffled for the whole corpus.  The texts of lines are needed
where a leaf holds several different lines that occur often enough together to make a
recurring template.  A line joins a template only if it shares so many tokens with the
template's first line that one of a few blocks of tokens is equal; so an overfull leaf is
parted, without changing any template, into lines that equal blocks connect.
"""

from __future__ import annotations

import math
import re
from array import array
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, cut, prepare, slices
from .components import components

#: Documents in which a template must occur, share of equal fixed tokens to join one.
MIN_DOCS, SIMILAR = 10, 0.8
#: Leading tokens on the path, and the most different lines in a leaf before it is parted.
DEPTH, LEAF = 4, 2000
#: Up to this many rows a table of 8-byte keys is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000

ANY = "<*>"
_digit = re.compile(r"[0-9]")


def tokens(line: str) -> list[str]:
    """Tokens of a line, with variable fields in place of those that hold a digit."""
    words = line.split()
    return [ANY if _digit.search(w) else w for w in words] if _digit.search(line) else words


def line_key(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words))


def path_key(words: list[str]) -> int:
    """Key of the leaf that the line falls in."""
    return xxhash.xxh3_64_intdigest(f"{len(words)} " + " ".join(words[:DEPTH]))


def blocks(words: list[str]) -> list[int]:
    """Keys of the line's blocks.  Two lines of a leaf that share SIMILAR of their tokens have one in common: there is
    one block more than tokens in which they may differ (fields always do), and blocks with a field are left out."""
    free = len(words) - math.ceil(SIMILAR * len(words)) - words[:DEPTH].count(ANY)
    if free < 0:
        return []
    edges = [DEPTH + (len(words) - DEPTH) * j // (free + 1) for j in range(free + 2)]
    return [xxhash.xxh3_64_intdigest(f"{j} " + " ".join(words[a:b])) for j, (a, b) in enumerate(pairwise(edges)) if ANY not in words[a:b]]


def signed(numbers: list[int]) -> np.ndarray:
    return np.array(numbers, dtype=np.uint64).view(np.int64)


def _batches(batches, of_text):
    """Rows that ``of_text(text)`` lists, with the batch's other columns repeated."""
    claim(__name__)
    for batch in batches:
        texts = [x or "" for x in batch.column(0).to_pylist()]
        for a, b in slices([len(x) for x in texts]):
            counts, columns = [], None
            for text in texts[a:b]:
                made = of_text(text)
                counts.append(len(made[0]))
                columns = columns or [[] for _ in made]
                for c, m in zip(columns, made, strict=True):
                    c.extend(m)
            index = pa.array(np.repeat(np.arange(a, b), counts))
            yield [c.take(index) for c in batch.columns[1:]], columns


def line_hashes(docs: DataFrame, ids: list[str], text: str) -> DataFrame:
    """One row for each different line of each row: ``ids``, the line's key ``h`` and its leaf's key."""
    prepare(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in ids] + [T.StructField(c, T.LongType()) for c in ("h", "leaf")])

    def of_text(text: str):
        seen = {}
        for line in text.split("\n"):
            if (words := tokens(line)) and (h := line_key(words)) not in seen:
                seen[h] = path_key(words)
        return [list(seen), list(seen.values())]

    def run(batches):
        for kept, columns in _batches(batches, of_text):
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(signed(c)) for c in columns]], names=schema.names)

    return docs.select(F.col(text).cast("string"), *ids).mapInArrow(run, schema)


def line_texts(docs: DataFrame, text: str) -> DataFrame:
    """``h`` and ``line`` (tokens joined by blanks) of the different lines of each row."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("line", T.StringType())])

    def of_text(text: str):
        seen = {}
        for line in text.split("\n"):
            if words := tokens(line):
                seen[line_key(words)] = " ".join(words)
        return [list(seen), list(seen.values())]

    def run(batches):
        for _, (h, lines) in _batches(batches, of_text):
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(lines, pa.string())], names=schema.names)

    return docs.select(F.col(text).cast("string")).mapInArrow(run, schema)


class Leaf:
    """Templates of a leaf's lines, which come one by one.  It holds the templates, not the lines."""

    def __init__(self):
        self.ids: dict[str, int] = {ANY: 0}
        self.rows = np.empty((0, 0), dtype=np.int32)
        self.n = 0
        self.met: dict[int, list[int]] = {}  # templates by the blocks of their first lines

    def join(self, words: list[str]) -> int:
        """Number of the template that the line joins or founds."""
        keys = blocks(words)
        lists = [self.met[k] for k in keys if k in self.met]
        if lists:
            near = np.arange(self.n) if 4 * sum(map(len, lists)) > self.n else np.unique(np.concatenate(lists))
            row = np.array([self.ids.get(w, -1) for w in words], dtype=np.int32)
            found = self.rows[near]
            fixed = ((found == row) & (row != 0)).sum(axis=1)
            best = int(fixed.argmax())
            if fixed[best] >= SIMILAR * len(row):
                self.rows[near[best]] = np.where(found[best] == row, row, 0)
                return int(near[best])
        if self.n == len(self.rows):
            rows = np.empty((max(16, 2 * self.n), len(words)), dtype=np.int32)
            rows[: self.n] = self.rows if self.n else rows[:0]
            self.rows = rows
        self.rows[self.n] = [self.ids.setdefault(w, len(self.ids)) for w in words]
        for k in keys:
            self.met.setdefault(k, []).append(self.n)
        self.n += 1
        return self.n - 1

    def texts(self) -> list[str]:
        words = list(self.ids)
        return [" ".join([words[w] for w in t]) for t in self.rows[: self.n].tolist()]


def leaf_templates(lines: list[str], docs: list[int]) -> list[str]:
    """Template of each line of a leaf (all of one token count).

    Lines are taken by falling number of documents, then in text order, so that the result
    does not hang on how the rows came.  A line joins the template with most equal fixed
    tokens if that is a share of SIMILAR of all; fields it differs in become variable.
    """
    leaf = Leaf()
    of = {i: leaf.join(lines[i].split(" ")) for i in sorted(range(len(lines)), key=lambda i: (-docs[i], lines[i]))}
    texts = leaf.texts()
    return [texts[of[i]] for i in range(len(lines))]


def _templates(batches):
    """``h, t`` for rows (``part, leaf, h, line``) that come part by part, in the order in which lines are taken."""
    claim(__name__)

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    for (_, key), lines in groupby(rows(), itemgetter(0, 1)):
        leaf, hashes, of = Leaf(), array("q"), array("q")
        for _, _, h, line in lines:
            hashes.append(h)
            of.append(leaf.join(line.split(" ")))
        t = signed([xxhash.xxh3_64_intdigest(f"{key} {x}") for x in leaf.texts()])
        hashes, of = np.array(hashes), np.array(of)
        for a in range(0, len(of), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[a : a + 100_000]), pa.array(t[of[a : a + 100_000]])], names=["h", "t"])


def _parted(full: DataFrame) -> DataFrame:
    """``h, part`` for rows (``h, leaf, line``): lines of a leaf that no chain of equal blocks connects are in different parts."""

    def run(batches):
        for batch in batches:
            made = [[xxhash.xxh3_64_intdigest(f"{leaf} {b}") for b in blocks(line.split(" "))] for leaf, line in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rows = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(signed([b for m in made for b in m]))], names=["h", "block"])

    keys = cut(full.select("h", "leaf", "line").mapInArrow(run, "h long, block long"), "blocks")
    met = keys.groupBy("block").agg(F.min("h").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    labels = components(keys.join(met, "block").select(F.col("h").alias("a"), "b"))
    return full.select("h").join(labels, F.col("h") == F.col("node"), "left").select("h", F.coalesce("label", "h").alias("part"))


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join with a table of keys, broadcast only if it is counted and small."""
    small = right.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def recurring_lines(lines: DataFrame, docs: DataFrame, first: str, ids: list[str], text: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h, t, docs, keep``: each line key whose template recurs, the template's key, its number of documents
    and the smallest ``first`` among them."""
    different = cut(lines.groupBy("h", "leaf").agg(F.count("*").alias("docs"), F.min(first).alias("keep")), "lines")
    # Leaves with several lines that together occur often enough.
    many = (F.col("n") > 1) & (F.col("all") >= min_docs)
    leaves = different.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("all")).where(many)
    wanted = cut(different.join(leaves, "leaf").select("h", "docs", "leaf", (F.col("n") > LEAF).alias("full")), "wanted")
    texts = _joined(line_texts(docs, text), wanted.select("h"), "h").groupBy("h").agg(F.min("line").alias("line"))
    known = wanted.join(texts, "h").withColumn("part", F.col("leaf"))
    if not wanted.where("full").isEmpty():
        known = cut(known, "known")
        parted = known.where("full").drop("part").join(_parted(known.where("full")), "h")
        known = known.where("NOT full").unionByName(parted)
    ordered = known.repartition("part", "leaf").sortWithinPartitions("part", "leaf", F.desc("docs"), "line")
    templates = cut(ordered.select("part", "leaf", "h", "line").mapInArrow(_templates, "h long, t long"), "templates")
    # A template's documents: those of all its lines, each counted once.
    members = _joined(lines.select(*ids, "h"), templates, "h")
    shared = members.groupBy("t", *ids).agg(F.lit(1).alias("one")).groupBy("t").agg(F.count("*").alias("docs"), F.min(first).alias("keep"))
    clustered = templates.join(shared.where(F.col("docs") >= min_docs), "t").select("h", "t", "docs", "keep")
    alone = different.where(F.col("docs") >= min_docs).join(templates.select("h"), "h", "left_anti").select("h", F.col("h").alias("t"), "docs", "keep")
    return clustered.unionByName(alone)


def _kept_lines(text: str | None, gone) -> tuple[str | None, int, int]:
    """The text less the lines for whose key ``gone(h)`` holds, its number of lines with a token, and how many went."""
    parts = (text or "").split("\n")
    words = [tokens(p) for p in parts]
    kept = [p for p, w in zip(parts, words) if not w or not gone(line_key(w))]
    n = sum(map(bool, words))
    return (text if len(kept) == len(parts) else "\n".join(kept)), n, len(parts) - len(kept)


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` with the text less its recurring lines, then ``n_lines`` and ``n_dropped`` (long).

    A line recurs if its template occurs in ``min_docs`` rows or more (repeated rows count
    each; a null key counts as a document of its own kind).  The row with the smallest key
    keeps it, as do all rows repeating that row.  Lines are what ``\\n`` parts; lines without
    a token always stay and are not counted.  A null text stays null with 0 lines; a text
    of which nothing is dropped stays as it is.  Columns named ``n_lines`` or ``n_dropped``
    in ``docs`` are replaced, whatever other names they have.  An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_dropped")
    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    lines = cut(line_hashes(narrow, ["key", "hash"], "text"), "line-hashes")
    recurring = cut(recurring_lines(lines, narrow, "key", ["key", "hash"], "text", min_docs), "recurring")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = docs.columns
    body, named = names.index(text), names.index(key)

    def rows(batch, made):
        columns = list(batch.columns[: len(names)])
        columns[body] = pa.array([m[0] for m in made], pa.string())
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([m[k] for m in made], pa.int64()) for k in (1, 2)]], names=schema.names)

    if recurring.count() <= BROADCAST_ROWS:  # counted: the keys of recurring lines and who keeps them go to the texts
        found = recurring.select("h", "keep").toArrow().sort_by("h")
        shared = docs.sparkSession.sparkContext.broadcast((found.column("h").to_numpy().view(np.uint64), found.column("keep").to_pylist()))

        def run(batches):
            claim(__name__)
            hashes, keeps = shared.value
            keeper = dict(zip(hashes.tolist(), keeps))
            for batch in batches:
                made = []
                for x, own in zip(batch.column(body).to_pylist(), batch.column(named).to_pylist()):
                    made.append(_kept_lines(x, lambda h, own=own: h in keeper and keeper[h] != own))
                yield rows(batch, made)

        return docs.mapInArrow(run, schema)

    hits = lines.select("key", "hash", "h").join(recurring.select("h", "keep"), "h").where(~F.col("key").eqNullSafe(F.col("keep")))
    drops = hits.groupBy("key", "hash").agg(F.collect_set("h").alias("drop")).alias("d")
    # The rows' own columns travel as one struct, so that no name of theirs clashes.
    own = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("own_key"), F.xxhash64(text).alias("own_hash"))
    joined = own.join(drops, F.col("own_key").eqNullSafe(F.col("d.key")) & (F.col("own_hash") == F.col("d.hash")), "left").select("row", "drop")

    def run_joined(batches):
        claim(__name__)
        for batch in batches:
            flat = pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names)
            made = []
            for x, gone in zip(flat.column(body).to_pylist(), batch.column(1).to_pylist()):
                gone = {h & (2**64 - 1) for h in gone or []}
                made.append(_kept_lines(x, gone.__contains__))
            yield rows(flat, made)

    return joined.mapInArrow(run_joined, schema)
