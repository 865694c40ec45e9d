"""Which hashes were seen before: a bitmap of hash bits sorts out what is surely new, and only the rest is looked up.

A filter is a small table ``bucket, bitmap`` of at most 2^bits bits (2^bits / 8 bytes, whatever the number of hashes);
filters of several versions are merged.  With b bits and n hashes seen, a share of about n / 2^b of the new
ones is looked up in vain; results never hang on the filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^24 bits are 2 MB; 2^28, the most allowed because filters are broadcast, 32 MB.
BITS, MOST_BITS = 24, 28


def _place(column: str, bits: int) -> Column:
    if not 15 <= bits <= MOST_BITS:
        raise ValueError(f"bits must be from 15 to {MOST_BITS}")
    return F.pmod(F.xxhash64(column), F.lit(1 << bits)) + 1


def seen_filter(hashes: DataFrame, column: str = "content_hash", bits: int = BITS) -> DataFrame:
    """The filter of these hashes; tasks set bits before anything is shuffled.  Nulls are left out."""
    place = _place(column, bits)
    known = hashes.where(F.col(column).isNotNull())
    return known.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def merge_filters(*filters: DataFrame) -> DataFrame:
    """One filter for all versions (all of the same number of bits)."""
    return reduce(DataFrame.unionByName, filters).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def possibly_seen(df: DataFrame, known: DataFrame, column: str = "content_hash", bits: int = BITS) -> DataFrame:
    """Adds ``possible``: false where the hash was surely not seen."""
    place = _place(column, bits)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    at = F.bitmap_bucket_number(place) == F.col("__bucket")
    joined = df.join(F.broadcast(known.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))), at, "left")
    is_set = F.call_function("getbit", byte.cast("long"), (bit % 8).cast("int")) == 1
    return joined.withColumn("possible", F.coalesce(is_set, F.lit(False))).drop("__bucket", "__bitmap")


def first_seen(batch: DataFrame, seen: DataFrame, known: DataFrame, column: str = "content_hash", bits: int = BITS) -> DataFrame:
    """Distinct hashes of the batch that are not among ``seen``; ``known`` is the filter of ``seen``.  Only possible hits are
    joined with it."""
    told = possibly_seen(batch.where(F.col(column).isNotNull()).select(column).distinct(), known, column, bits)
    maybe = told.where("possible").select(column).join(seen.select(column), column, "left_anti")
    return told.where("NOT possible").select(column).unionByName(maybe)
