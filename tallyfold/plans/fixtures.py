"""The driver's tables seen as inventories, index tables and pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, WIDE, HIGH = 8, 24, 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sha(c) -> Column:
    return F.sha2(c, 256)


def tagged(letter: str, c: str = "h0") -> Column:
    return sha(F.concat(F.lit(letter), F.col(c)))


def docs_files(spark: SparkSession, sf: str) -> DataFrame:
    return as_files(table(spark, sf, "documents")).drop("text")


def as_files(d: DataFrame) -> DataFrame:
    """Documents as listing rows with their hashes and texts."""
    n = F.col("doc_id")
    ending = F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".heic", ".txt", ".HEIF", ".jfif", "", ".png"))), (n % 8 + 1).cast("int"))
    name = F.when(n % 41 == 0, ".picasa.ini").when(n % 37 == 0, F.concat(F.lit("._IMG_"), n, F.lit(".jpg"))).otherwise(F.concat(F.lit("IMG_"), n, ending))
    return d.select(
        "doc_id", "text", (F.substring("source", 4, 10).cast("int") < 5).alias("is_src"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), n, F.lit("/"), name).alias("path"), n.alias("inode"),
        F.when(n % 29 == 0, 40000000).when(n % 29 == 8, 40000001).otherwise(F.octet_length("text")).cast("long").alias("size"),
        ((n - 100) * 1000000007).alias("mtime_ns"), F.when(n % 53 == 0, "io error").alias("error"), sha("text").alias("h0"),
        F.when(n % 8 != 2, sha(F.translate("text", UPPER, UPPER.lower()))).alias("h1"), F.when(n % 8 != 3, sha(F.translate("text", "0123456789 ,.", ""))).alias("h2"),
    )


def files_old(spark: SparkSession, sf: str) -> DataFrame:
    d, n = docs_files(spark, sf), F.col("doc_id")
    kept = d.where(n % 10 != 0).select(
        "path", (F.col("inode") + (n % 10 == 3).cast("long")).alias("inode"), (F.col("size") + (n % 10 == 2).cast("long")).alias("size"),
        (F.col("mtime_ns") + (n % 10 == 1).cast("long")).alias("mtime_ns"), F.col("h0").alias("content_hash"),
    )
    gone = d.where(n % 50 == 9).select(F.concat(F.lit("/gone/"), n).alias("path"), "inode", "size", "mtime_ns", F.col("h0").alias("content_hash"))
    return kept.unionByName(gone)


def _first_of_hash(spark: SparkSession, sf: str) -> DataFrame:
    return docs_files(spark, sf).groupBy("h0").agg(F.min("doc_id").alias("k"))


def images_tbl(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    valid = k % 6 != 1
    return _first_of_hash(spark, sf).where(k % 6 != 0).select(
        F.col("h0").alias("content_hash"), F.when(valid, 100 + k % 50).cast("int").alias("width"), F.when(valid, 80 + k % 40).cast("int").alias("height"),
        F.when(valid & (k % 7 != 0), tagged("r")).alias("rothash"), F.when(valid, tagged("b")).alias("blockhash"),
    )


def extra_tbl(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return _first_of_hash(spark, sf).where(k % 4 != 0).select(
        F.col("h0").alias("content_hash"), tagged("m").alias("md5"), F.when(k % 4 != 1, tagged("s")).alias("sha1"), F.when(k % 4 != 1, tagged("t")).alias("sha256")
    )


def observed(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id") % 12
    i = images_tbl(spark, sf).withColumnRenamed("content_hash", "h0")
    return docs_files(spark, sf).select("doc_id", "path", "h0").join(i, "h0", "left").select(
        "path", F.when(n == 1, tagged("x")).otherwise(F.col("h0")).alias("content_hash"), (n != 2).alias("decode_ok"),
        (F.col("width") + (n == 3).cast("int")).alias("width"), "height", F.when(n == 4, tagged("y")).otherwise(F.col("rothash")).alias("rothash"),
        F.when(n == 5, tagged("z")).otherwise(F.col("blockhash")).alias("blockhash"),
    )


def grids_src(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1.0) * 127.5))).cast("int")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.transform("embedding", cell).alias("values")
    )


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of WIDE by HIGH cells, whose blocks of 16 by 16 have fractional edges."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(WIDE * HIGH - 1)), lambda i: F.element_at("values", ((i * 7 + F.floor(i / WIDE) * 3) % 64 + 1).cast("int")))
    return grids_src(spark, sf).select("vec_id", F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"), cells.alias("values"))


def grids_dst(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.grids import _permuted

    v = F.col("values")
    part = F.array_sort(F.slice(v, 1, 16))
    median = (part[7] + part[8]) / 2
    nudged = F.concat(F.array(F.when(v[0] > median, v[0] + 1).otherwise(v[0] - 1)), F.slice(v, 2, 63))
    n = F.col("vec_id") % 4
    turned = _permuted(v, F.col("width"), F.col("height"), "rot90")
    return grids_src(spark, sf).where(n < 3).withColumn("values", F.when(n == 0, v).when(n == 1, turned).otherwise(nudged))


def listings(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    d, n = docs_files(spark, sf), F.col("doc_id")
    return {
        "a": d.where(n % 11 != 0),
        "b": d.where(n % 13 != 0).withColumn("size", F.col("size") + (n % 17 == 0).cast("long")),
        "c": d.where(n % 19 != 0).withColumn("mtime_ns", F.col("mtime_ns") + (n % 23 == 0).cast("long")),
    }


def before_after(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d, n = docs_files(spark, sf), F.col("doc_id")
    before = d.select("path", "inode", "size", "mtime_ns")
    after = d.select("path", "inode", (F.col("size") + (n % 31 == 0).cast("long")).alias("size"), (F.col("mtime_ns") + (n % 31 == 1).cast("long")).alias("mtime_ns"))
    return before, after


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mtime_ns"), "value",
    )


def orient_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "Orientation").otherwise("Other").alias("tag"),
        F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(k % 10)).alias("value"),
    )
