"""Helpers shared by the text operators: reading, Arrow mapping, cut lineage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import cut, discard, drop, release, shared_dir  # noqa: F401 - for the operators and their callers

#: Texts are handed to a task's function in groups of about this many characters.
SLICE_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_memories: dict[str, Callable[[], None]] = {}
_owner = ""


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Tell how to drop what an operator keeps in a Python worker."""
    _memories[name] = forget


def claim(name: str) -> None:
    """Called when a task begins.  Spark uses Python workers again for later stages: what other operators keep in
    this one is dropped, and what earlier tasks freed goes back, so that memory does not add up over stages and runs."""
    global _owner
    if _owner != name:
        _owner = name
        for owner, forget in list(_memories.items()):
            if owner != name:
                forget()
        gc.collect()
    trim()


def trim() -> None:
    """Give free memory back: where large arrays come and go, a task calls it between them."""
    pa.default_memory_pool().release_unused()
    try:  # what is free goes back to the system, which else counts it as this worker's
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def given_back(run: Callable, forget: Callable[[], None] = lambda: None) -> Callable:
    """A function of mapInArrow that gives free memory back when its task ends, and what ``forget`` drops: workers that later
    stages do not need keep what they hold for a while."""

    def until_the_end(batches):
        yield from run(batches)
        forget()
        trim()

    return until_the_end


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long rows (a batch is also bounded in bytes), and those of the Parquet reader, which
    holds a whole batch of each column as one array: 4096 vectors of shingles, the default, take 40 MB and more in each task."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    except Exception:  # noqa: BLE001 - the setting is absent before Spark 4.1
        return


def slices(sizes: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive groups whose sizes add up to about ``most``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def map_texts(
    df: DataFrame,
    text: str,
    keep: list[str],
    fields: list[T.StructField],
    function: Callable[[list[str]], list],
) -> DataFrame:
    """``keep`` columns as they are, then ``fields`` made from the text column.

    ``function`` takes a list of texts (null is the empty text) and gives one list,
    numpy or Arrow array per field.  It runs in Arrow batches, group by group.
    """
    prepare(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(schema)
    types = [f.type for f in arrow][len(keep):]

    owner = function.__module__

    def run(batches):
        claim(owner)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            kept = batch.columns[1:]
            for a, b in slices([len(x) for x in texts]):
                made = function(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in kept]
                    + [m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, types, strict=True)],
                    names=[f.name for f in arrow],
                )

    narrow = df.select(F.col(text).cast("string").alias("__text"), *[F.col(c) for c in keep])
    return narrow.mapInArrow(given_back(run), schema)


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_texts(texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(texts))


def unpack_texts(sizes: list[int], packed: bytes) -> list[bytes]:
    """Texts of these sizes."""
    data, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum([0, *sizes]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]
