"""Shortest prefix that tells all hashes apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def common_prefix(a: Column, b: Column, longest: int) -> Column:
    """Number of equal leading characters of two hex texts."""
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda i: (F.left(a, i) == F.left(b, i)) & (i <= F.length(a)) & (i <= F.length(b))))


def min_unique_prefix(df: DataFrame, column: str, bucket: int = 4, longest: int = 64) -> DataFrame:
    """One row ``n``: the longest common prefix of neighbours among the distinct hashes, plus one; 0 for no
    hash, 1 for one.

    Neighbours are found inside buckets of equal first characters.  If any bucket holds two,
    their prefix is at least as long as the bucket's; else only the buckets' heads, at most
    16^bucket, are compared with each other.
    """
    hashes = df.where(F.col(column).isNotNull()).select(F.col(column).alias("h")).distinct()

    def longest_among(rows: DataFrame, window) -> DataFrame:
        return rows.withColumn("p", common_prefix(F.col("h"), F.lag("h").over(window), longest))

    bucketed = hashes.withColumn("b", F.left("h", F.lit(bucket)))
    inner = longest_among(bucketed, Window.partitionBy("b").orderBy("h")).agg(F.max("p").alias("p"), F.count("*").alias("n"), F.count_if(F.col("p") > 0).alias("pairs"))
    heads = bucketed.groupBy("b").agg(F.min("h").alias("h"))
    outer = longest_among(heads, Window.orderBy("h")).agg(F.max("p").alias("outer"))
    both = inner.unionByName(outer, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("p", "n", "pairs", "outer")])
    return both.select(
        F.when(F.col("n") == 0, 0).when(F.col("n") == 1, 1)
        .otherwise(1 + F.when(F.col("pairs") > 0, F.col("p")).otherwise(F.coalesce("outer", F.lit(0)))).cast("long").alias("n")
    )


def min_unique_by_halving(df: DataFrame, column: str, longest: int = 64) -> DataFrame:
    """The same by counts of distinct prefixes: the shortest length at which there are as many as hashes is halved in on.

    A count combines within tasks, however many hashes begin alike, so that no prefix is hot; there is no window and no
    join, and a pass for each of about seven lengths.
    """
    hashes = cut(df.where(F.col(column).isNotNull()).select(F.col(column).alias("h")).distinct(), "hashes")
    n = hashes.count()
    low, high = 1, longest
    while n > 1 and low < high:
        middle = (low + high) // 2
        if hashes.select(F.left("h", F.lit(middle)).alias("p")).distinct().count() == n:
            high = middle
        else:
            low = middle + 1
    return df.sparkSession.range(1).select(F.lit(min(n, 1) if n < 2 else low).cast("long").alias("n"))


def hash_neighbours(df: DataFrame, column: str, longest: int = 64) -> DataFrame:
    """``hash, previous, common``: the distinct hashes, the one before each in the order of all, and how many leading characters
    they share (null and 0 for the first).

    Hashes are dealt by range; neighbours are found inside a range, and the last hash of each range, one row each, is handed
    to the first of the next one that has any.
    """
    hashes = df.where(F.col(column).isNotNull()).select(F.col(column).alias("hash")).distinct()
    dealt = cut(hashes.repartitionByRange("hash").withColumn("range", F.spark_partition_id()), "ranges")
    inner = dealt.withColumn("before", F.lag("hash").over(Window.partitionBy("range").orderBy("hash")))
    ends = dealt.groupBy("range").agg(F.max("hash").alias("last")).agg(F.sort_array(F.collect_list(F.struct("range", "last"))).alias("ends"))
    earlier = F.try_element_at(F.filter("ends", lambda e: e["range"] < F.col("range")), F.lit(-1))["last"]
    stitched = inner.where("before IS NULL").crossJoin(F.broadcast(ends)).select("hash", earlier.alias("previous"))  # a row a range, and one row
    both = inner.where("before IS NOT NULL").select("hash", F.col("before").alias("previous")).unionByName(stitched)
    return both.withColumn("common", F.when(F.col("previous").isNull(), 0).otherwise(common_prefix(F.col("hash"), F.col("previous"), longest)))
