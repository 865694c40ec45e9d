"""The index kept up to date from a stream of listing rows, as keyed state.

Spark's state store holds one row for each key; a micro-batch reads and writes the keys that it has rows
of and no others.  What Spark hands to Python at a time is a bucket of keys: a hand-over costs about a
millisecond, whether it brings one row or many.  State is committed with the batch, so that a batch that
is run again starts from the state before it and gives the same rows.  ``current_rows`` reads the table
that the state is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..schema import FILES, INFO

#: Keys are dealt into so many buckets by their hashes.  A state keeps the number that it was begun with.
BUCKETS = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_contents_stream(stream: DataFrame, column: str = "content_hash") -> DataFrame:
    """Each content hash when it is first seen.  There is no watermark: "seen" does not expire, so the state
    grows with the distinct hashes (use the RocksDB state store for large ones)."""
    return stream.select(column).where(F.col(column).isNotNull()).dropDuplicates([column])


class KeyedRows(StatefulProcessor):
    """One row of ``fields`` for each key, in a map of the key's bucket.  Of a key's rows in a batch the one of the largest
    ``order`` counts; ``decide(old, row)`` gives the new values, or None to leave the state as it is."""

    def __init__(self, keys: T.StructType, fields: T.StructType, decide: Callable[[tuple | None, Row], tuple | None], order: Callable[[Row], Any]):
        self.keys, self.fields, self.decide, self.order = keys, fields, decide, order
        self.names = [*keys.names, *fields.names]

    def init(self, handle) -> None:
        self.rows = handle.getMapState("row", self.keys, self.fields)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.rows.updateValue(tuple(initialState[n] for n in self.keys.names), tuple(initialState[n] for n in self.fields.names))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best: dict[tuple, Row] = {}
        for row in rows:
            of = tuple(row[n] for n in self.keys.names)
            if of not in best or self.order(row) > self.order(best[of]):
                best[of] = row
        for of, row in best.items():
            new = self.decide(self.rows.getValue(of), row)
            if new is not None:
                self.rows.updateValue(of, new)
                yield Row(**dict(zip(self.names, (*of, *new))))

    def close(self) -> None:
        pass


def _in_order(column: str | None) -> Callable[[Row], Any]:
    """Rows by the column, null before all; equal ones by their values."""
    def of(row: Row):
        value = row[column] if column else 0
        return (value is not None, value if value is not None else 0, str(row))

    return of


def keyed_rows(stream: DataFrame, keys: list[str], fields: T.StructType, decide, order: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The rows of ``keys`` and ``fields`` that a stream changes, and the state that they are kept in.  ``initial`` (keys and fields)
    is there before the first batch."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a commit writes what changed
    named = T.StructType([stream.schema[k] for k in keys])
    out = T.StructType([*named.fields, *fields.fields])

    def dealt(rows: DataFrame):
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).groupBy("__bucket")

    return dealt(stream).transformWithState(KeyedRows(named, fields, decide, _in_order(order)), out, "Update", "None", None if initial is None else dealt(initial))


def latest_stream(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` for each key, given out whenever it changes; rows with an ``error`` are passed over."""
    fields = T.StructType([f for f in stream.schema.fields if f.name not in (*keys, "error")])
    place = fields.names.index(order)
    names = fields.names

    def decide(old, row):
        if old is not None and old[place] is not None and (row[order] is None or row[order] < old[place]):
            return None
        return tuple(row[n] for n in names)

    return keyed_rows(_sound(stream), keys, fields, decide, order)


def index_stream(listing: DataFrame, digest: Callable[[Row], str], index: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """New and changed files of a stream of listing rows, with ``content_hash`` and ``status``.

    A file whose inode, size and time are those of its row in the state is unchanged: it is not
    given out, and not digested.  ``digest(row)`` gives the hash of a file that is new or changed.
    ``index`` holds the files known before.  Rows with an ``error`` are passed over and do not stop the rest.
    """
    fields = T.StructType([*[f for f in FILES.fields if f.name != "path"], T.StructField("status", T.StringType())])

    def decide(old, row):
        info = tuple(row[c] for c in INFO)
        if old is not None and tuple(old[: len(INFO)]) == info:
            return None
        return (*info, digest(row), "new" if old is None else "changed")

    known = None if index is None else index.select(*FILES.names, F.lit("unchanged").alias("status"))
    return keyed_rows(_sound(listing), ["path"], fields, decide, order, known)


def _sound(stream: DataFrame) -> DataFrame:
    return stream.where("error IS NULL") if "error" in stream.columns else stream


def start(rows: DataFrame, folder: str):
    """Run such a stream until its input is drained: what changes goes to ``folder/changes``, one folder a batch, which a batch
    that is run again writes again; the state is in ``folder/state``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def current_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all keys after the last batch, from the state itself."""
    state = spark.read.format("statestore").option("stateVarName", "row").load(f"{folder}/state")
    return state.select("user_map_key.*", "user_map_value.*")
