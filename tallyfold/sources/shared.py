"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is set, a temporary one serves on one machine (tests); a cluster needs one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later steps
    neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files stay on the executors' disks until the driver collects its garbage, which it may not do for long: have it
    collected when a large step is done and nothing refers to it any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop(*tables: DataFrame) -> None:
    """Remove these tables, which :func:`cut` gave, before the results are written: nothing reads them any more."""
    for table in tables:
        folders = {x.rsplit("/", 2)[-2] for x in table.inputFiles()}
        for path in [x for x in _written if x.rsplit("/", 1)[1] in folders]:
            where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            _written.remove(path)


def discard(spark: SparkSession) -> None:
    """Remove all that this process has cut so far; to be called when the results are written."""
    while _written:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
