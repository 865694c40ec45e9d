"""Listings and index tables as sources and sinks."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXTRA, FILES, IMAGES, KEYS, LISTING
from .shared import exists


def read_inventory(spark: SparkSession, roots: list[str], content: bool = False) -> DataFrame:
    """Regular files under the roots: ``path, inode, size, mtime_ns, error`` (and ``content``).

    For any store that Spark reads.  The file source leaves out empty files and names that start with ``_`` or ``.``, knows no
    inode (0) and times only to the millisecond; use :func:`tallyfold.sources.listing.list_folders` for mounted folders, or a ready
    listing (:func:`read_listing`), where these matter.
    Without ``content`` the files are listed and not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    path = F.regexp_replace("path", r"\Afile:(//)?(?=/)", "")
    out = files.select(
        path.alias("path"), F.lit(0).cast("long").alias("inode"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(None).cast("string").alias("error"),
        *(["content"] if content else []),
    )
    return out


def as_listing(df: DataFrame) -> DataFrame:
    """Rows of another table as a listing: hidden and empty files and failed entries included, one row for each."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in LISTING.fields])


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """A ready listing with the LISTING schema."""
    return as_listing(spark.read.schema(LISTING).parquet(path))


@dataclass
class Index:
    """The three index tables."""

    files: DataFrame
    images: DataFrame
    extra: DataFrame


SCHEMAS = {"files": FILES, "images": IMAGES, "extra": EXTRA}


def read_index(spark: SparkSession, folder: str) -> Index:
    """The tables of a version; one that was written in buckets is read with them."""
    laid = spark.read.schema("name string, key string, buckets int").json(f"{folder}/layout").collect() if exists(spark, f"{folder}/layout") else []
    if not laid:
        return Index(**{n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in SCHEMAS.items()})
    tables = {}
    for row in laid:
        name, schema = _table_name(folder, row["name"]), SCHEMAS[row["name"]]
        location = f"{folder}/{row['name']}".replace("\\", "\\\\").replace("'", "\\'")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{row['key']}`) SORTED BY (`{row['key']}`) INTO {row['buckets']} BUCKETS LOCATION '{location}'")
        tables[row["name"]] = spark.table(name)
    return Index(**tables)


def _table_name(folder: str, name: str) -> str:
    return f"index_{hashlib.md5(folder.encode()).hexdigest()}_{name}"


def write_index(index: Index, folder: str, buckets: int | None = None) -> str:
    """Write a new version under ``folder`` and give its path; a version that is being read is never touched.

    With ``buckets``, files are laid out by path and the other tables by content hash, so that joins on these keys
    shuffle the other side only.  Take as many as there are shuffle partitions, or more.
    """
    version = f"{folder}/v-{uuid.uuid4().hex}"
    for n, s in SCHEMAS.items():
        rows = getattr(index, n).select(*s.names)
        if buckets is None:
            rows.write.parquet(f"{version}/{n}")
            continue
        key = KEYS[n][0]
        dealt = rows.repartition(buckets, key)  # one file a bucket
        dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{version}/{n}").saveAsTable(_table_name(version, n))
    if buckets is not None:
        spark = index.files.sparkSession
        spark.createDataFrame([(n, KEYS[n][0], buckets) for n in SCHEMAS], "name string, key string, buckets int").coalesce(1).write.json(f"{version}/layout")
    return version


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the latest update of each key in place of its row; doing it again changes nothing."""
    latest = latest_rows(updates, keys, order).drop(order)
    return current.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` for each key, whole; of equal ones the one with the largest hash, so that the
    choice does not hang on how rows come.  Null orders come before all others.  Tasks aggregate before rows are shuffled."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    best = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(order, F.xxhash64(*hashed))).alias("row")
    return df.groupBy(*[F.col(k).alias(f"key_{n}") for n, k in enumerate(keys)]).agg(best).select("row.*")


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row: path, size, hash, then the further digests that there are."""
    return df.select(F.to_json(F.struct("path", "size", F.col("content_hash").alias("hash"), "md5", "sha1", "sha256")).alias("json"), "path")


def to_text_lines(df: DataFrame) -> DataFrame:
    """``hash size path`` lines: 12 hex digits, whole KiB right-aligned in 8, the path."""
    from ..functions.predicates import display_path, kib, short_hash

    return df.select(F.format_string("%s %8dK %s", short_hash(F.col("content_hash")), kib(F.col("size")), display_path(F.col("path"))).alias("line"))


def transfer_manifest(missing: DataFrame, source: str, actions: dict[str, str]) -> DataFrame:
    """``src_path, rel_path, out_path, action, error`` for each missing file and action (link, move, copy).

    At least one action is needed and no output may lie in the source.  A path outside the
    source keeps a row with an error.
    """
    from ..functions.predicates import relative_to

    if not actions or set(actions) - {"link", "move", "copy"}:
        raise ValueError("give at least one of the actions link, move and copy")
    inside = source.rstrip("/") + "/"
    for root in actions.values():
        if (root.rstrip("/") + "/").startswith(inside):
            raise ValueError("output within the source")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(r.rstrip("/")).alias("root")) for a, r in sorted(actions.items())]))
    rel = relative_to(F.col("path"), source)
    return missing.select(F.col("path").alias("src_path"), rel.alias("rel_path"), pairs.alias("x")).select(
        "src_path", "rel_path", F.concat_ws("/", "x.root", "rel_path").alias("out_path"), "x.action",
        F.when(F.col("rel_path").isNull(), "not relative to source").alias("error"),
    ).withColumn("out_path", F.when(F.col("error").isNull(), F.col("out_path")))


def collisions(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned outputs that are there already."""
    return manifest.select("out_path").join(existing.select("out_path"), "out_path", "left_semi")
