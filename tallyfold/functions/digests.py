"""Content digests: computing, planning, merging, reporting, and the stable-read check."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import DIGESTS, INFO
from ..sources.shared import cut

_FUNCTIONS = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}
ATTEMPTS = 3
#: Bytes of a file that are read at a time.
READ_SIZE = 1 << 20
_NEW = T.StructField("new", T.StructType([T.StructField(d, T.StringType()) for d in DIGESTS]))
_INFO = T.StructType([T.StructField(c, T.LongType()) for c in INFO])


def with_digests(df: DataFrame, content: str, which=DIGESTS, key: str | None = "content_hash") -> DataFrame:
    """Adds the digests asked for and the key digest (SHA-256), all in lowercase hex, in the scan's own stage."""
    out = df.withColumns({d: _FUNCTIONS[d](F.col(content)) for d in which})
    return out.withColumn(key, F.sha2(F.col(content), 256)) if key else out


def held() -> Column:
    """Names of the digests that a row has."""
    return F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in DIGESTS]))


def plan_digests(df: DataFrame, desired=DIGESTS) -> DataFrame:
    """Adds ``todo`` (asked for and not held) and ``store_extra`` (all three are computed in this run)."""
    every = F.array(*map(F.lit, DIGESTS))
    want = F.array(*map(F.lit, desired)) if desired else F.array().cast("array<string>")
    return df.withColumn("todo", F.array_except(want, held())).withColumn(
        "store_extra", F.size(F.array_except(every, F.col("todo"))) == 0
    )


def merge_digests(df: DataFrame, new: str = "new") -> DataFrame:
    """Digests named in ``todo`` come from the struct ``new``, the others stay."""
    return df.withColumns({d: F.when(F.array_contains("todo", d), F.col(f"{new}.{d}")).otherwise(F.col(d)) for d in DIGESTS})


def hash_report(df: DataFrame, columns: dict[str, str], error: str = "error") -> DataFrame:
    """``path`` and the named hashes: the error's text if reading failed, else the hash, else ``missing``."""
    shown = [F.when(F.col(error).isNotNull(), F.col(error)).otherwise(F.coalesce(F.col(c), F.lit("missing"))).alias(n) for n, c in columns.items()]
    return df.select("path", *shown)


def info(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}.{c}") for c in INFO])


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path`` and whether inode, size and time were the same before and after the read."""
    return before.alias("b").join(after.alias("a"), "path").select("path", info("b").eqNullSafe(info("a")).alias("stable"))


def read_stable(todo: DataFrame, read: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Digests of files that held still, and the paths that changed in all of ATTEMPTS tries.

    ``read(paths)`` lists, digests and lists again, and gives the three tables, in the order in which they are to be made.
    """
    done, left = None, todo.select("path")
    for _ in range(ATTEMPTS):
        # Cut, so that the digests are those of the very read that was judged.
        before, digests, after = (cut(t, f"try-{name}") for name, t in zip(("before", "digests", "after"), read(left)))
        verdict = stable(before, after)
        good = digests.join(verdict.where("stable"), "path", "left_semi")
        done = good if done is None else done.unionByName(good)
        left = verdict.where("NOT stable").select("path")
        if left.isEmpty():
            break
    return done, left


def _hashers() -> dict:
    return {d: hashlib.new(d) for d in DIGESTS}


def digest_files(rows: DataFrame) -> DataFrame:
    """Reads the files that ``path`` names, on a file system that all executors see, block by block: adds ``content`` (the key
    digest), the struct ``new``, ``before`` and ``after`` (inode, size and time when reading began and ended) and ``failure`` (the
    system's words; null where the file was read).  Made for :func:`tallyfold.operators.index.read_contents`."""
    schema = T.StructType([*rows.schema.fields, T.StructField("content", T.StringType()), _NEW, T.StructField("before", _INFO), T.StructField("after", _INFO), T.StructField("failure", T.StringType())])
    types = [f.type for f in to_arrow_schema(schema)][-5:]
    place = rows.columns.index("path")

    def found(file) -> dict:
        seen = os.fstat(file.fileno())
        return {"inode": seen.st_ino, "size": seen.st_size, "mtime_ns": seen.st_mtime_ns}

    def one(path: str) -> tuple:
        hashers = _hashers()
        try:
            with open(path, "rb", buffering=0) as file:
                before = found(file)
                while block := file.read(READ_SIZE):
                    for h in hashers.values():
                        h.update(block)
                after = found(file)
        except OSError as e:
            return None, None, None, None, f"{e.strerror or e}: {path}"
        made = {d: h.hexdigest() for d, h in hashers.items()}
        return made["sha256"], made, before, after, None

    def run(batches):
        for batch in batches:
            made = [one(p) for p in batch.column(place).to_pylist()]
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def digest_blocks(blocks: DataFrame, keys: list[str], block: str = "block", data: str = "data") -> DataFrame:
    """``keys``, the digests, ``n_bytes`` and ``failure`` of contents that lie in blocks, numbered from 0.

    Blocks of a content meet in one task in their order and are digested one after the other, so that no content is ever
    held whole.  A block that is there twice with the same bytes counts once.  Where a block is missing, null or there with
    other bytes, digests are null and ``failure`` says which.
    """
    names = [*keys, block, data]
    fields = [blocks.schema[k] for k in keys]
    schema = T.StructType([*fields, *[T.StructField(d, T.StringType()) for d in DIGESTS], T.StructField("n_bytes", T.LongType()), T.StructField("failure", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, hashers, size, following, last, failure = None, _hashers(), 0, 0, None, None
        done: list[tuple] = []

        def row() -> tuple:
            return (*key, *(None if failure else h.hexdigest() for h in hashers.values()), size, failure)

        def given():
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), arrow)], names=arrow.names)
            done.clear()

        for batch in batches:
            for *this, number, part in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None or this != key:
                    if key is not None:
                        done.append(row())
                    if len(done) >= 1000:
                        yield from given()
                    key, hashers, size, following, last, failure = this, _hashers(), 0, 0, None, None
                if failure:
                    continue
                if number is None or part is None:
                    failure = "a block or its number is null"
                elif number == following:
                    for h in hashers.values():
                        h.update(part)
                    size, following, last = size + len(part), following + 1, part
                elif number != following - 1:
                    failure = f"block {following} is missing"
                elif part != last:
                    failure = f"block {number} is there twice"
        if key is not None:
            done.append(row())
            yield from given()

    dealt = blocks.select(*names).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*names[:-1])
    return dealt.mapInArrow(run, schema)
