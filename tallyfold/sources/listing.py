"""A listing of folders as a Spark data source: every regular file, hidden and empty ones too, and what could not be read.

Register it once with ``spark.dataSource.register(FolderListing)``; then
``spark.read.format("folder_listing").option("roots", json).load()`` has the LISTING columns.  The folders must be on
a file system that driver and executors see under the same name.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import LISTING

#: Rows of a batch, and partitions that are planned if there are so many folders.
BATCH, PARTITIONS = 10_000, 64


class Subtree(InputPartition):
    """A folder (with all below it, or only what lies in it) or a single file."""

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


def _entry(path: str) -> tuple | None:
    """Listing row of a path, None where it is no regular file; links are not followed."""
    try:
        found = os.lstat(path)
    except OSError as e:
        return path, None, None, None, f"{e.strerror}: {path}"
    return (path, found.st_ino, found.st_size, found.st_mtime_ns, None) if stat.S_ISREG(found.st_mode) else None


def _listed(folder: str, folders: list[str]) -> Iterator[tuple]:
    """Rows of what lies in a folder; the folders in it are added to ``folders``."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    e.path.encode()
                except UnicodeEncodeError:
                    continue  # names that are no Unicode are passed over
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif row := _entry(e.path):
                    yield row
    except OSError as e:
        yield folder, None, None, None, f"{e.strerror}: {folder}"


class ListingReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        """Folders are opened level by level until there are enough; an opened one is a partition of what lies in it."""
        out: list[InputPartition] = []
        level = []
        for root in map(os.path.realpath, self.roots):
            level.append(root) if os.path.isdir(root) else out.append(Subtree(root, False))
        while level and len(level) < PARTITIONS:
            below: list[str] = []
            for folder in level:
                for _ in _listed(folder, below):
                    pass
                out.append(Subtree(folder, False))
            level = below
        return [*out, *(Subtree(folder, True) for folder in level)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(LISTING)

        def rows() -> Iterator[tuple]:
            if not os.path.isdir(partition.path):
                if row := _entry(partition.path):
                    yield row
                return
            folders = [partition.path]
            while folders:
                yield from _listed(folders.pop(), folders if partition.deep else [])

        batch: list[tuple] = []
        for row in rows():
            batch.append(row)
            if len(batch) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), schema)], schema=schema)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), schema)], schema=schema)


class FolderListing(DataSource):
    """Option ``roots``: a JSON list of folders or files."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self):
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(json.loads(self.options["roots"]))


def list_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``path, inode, size, mtime_ns, error`` of every regular file under the roots (a root may be a file), and a row with
    an error for each folder or file that could not be looked at, missing roots too."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("roots", json.dumps(roots)).load()
