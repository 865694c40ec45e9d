"""What operators leave in Python workers, and how much the Parquet reader holds at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from tallyfold.llm import common, weighted_near_dup

SF = "/root/testdata/sf0.001"


def test_parquet_batches_suit_long_rows(spark):
    common.prepare(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_draws_are_dropped_when_signatures_are_made(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.unhex(F.md5("text")).alias("node"))
    assert weighted_near_dup.signed_vectors(own, 100, 1000).count()

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([weighted_near_dup._draws.cache_info().currsize])], names=["n"])

    assert spark.range(8, numPartitions=8).mapInArrow(held, "n long").agg(F.sum("n")).first()[0] == 0
