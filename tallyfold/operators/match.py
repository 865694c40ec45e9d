"""Matching a source with destinations by equal hashes.

Inputs have ``path`` and the hash columns ``h0`` (content), ``h1`` (rotation), ``h2``
(block); a null hash never matches.  A match is a class of paths, known by kind and hash:
``class_sizes`` counts a class, ``class_members`` lists it one row a path, and the links of
a source path name classes, three at most, however many copies a hash has.  Lists of paths
(``hash_index``, ``find_matches``, ``diff``) are for reports: a list is one row, so that a
content with very many copies is better read as a class, or in chunks of bounded length
(``posting_chunks``, ``find_chunks``, ``first_tier_chunks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("h0", "h1", "h2")


def melted(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per file and hash: ``path, kind, hash``."""
    kinds = KINDS[:1] if exact else KINDS
    return df.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(h).alias("hash")) for k, h in enumerate(kinds)])).alias("x")).select(
        "path", "x.kind", "x.hash"
    ).where("hash IS NOT NULL")


def class_members(df: DataFrame, exact: bool = False) -> DataFrame:
    """``kind, hash, path``: the distinct paths of each hash, over all roots."""
    return melted(df, exact).select("kind", "hash", "path").distinct()


def class_sizes(df: DataFrame, exact: bool = False) -> DataFrame:
    """``kind, hash, n_paths``; equal rows are counted once before they meet."""
    return class_members(df, exact).groupBy("kind", "hash").agg(F.count("*").alias("n_paths"))


def duplicate_classes(df: DataFrame, exact: bool = False) -> DataFrame:
    """Hashes that more than one path has, with the number of paths."""
    return class_sizes(df, exact).where("n_paths > 1")


def find_classes(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    """``path, kind, hash, n_paths``: the destination's classes that each source path is linked to."""
    return class_members(src, exact).join(class_sizes(dest, exact), ["kind", "hash"]).select("path", "kind", "hash", "n_paths")


def hash_index(dest: DataFrame, exact: bool = False) -> DataFrame:
    """``kind, hash, paths``: the sorted set of paths of each hash, over all roots."""
    return melted(dest, exact).groupBy("kind", "hash").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def _hits(src: DataFrame, dest: DataFrame, exact: bool) -> DataFrame:
    """The classes of source paths with their lists, which are made for classes that are hit only."""
    hit = melted(src, exact)
    paths = melted(dest, exact).join(hit.select("kind", "hash").distinct(), ["kind", "hash"], "left_semi")
    return hit.join(paths.groupBy("kind", "hash").agg(F.array_sort(F.collect_set("path")).alias("paths")), ["kind", "hash"])


def find_matches(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    """Every source path, in order, with the sorted distinct destination paths over all kinds (empty: no match)."""
    found = _hits(src, dest, exact).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("matches"))
    return src.select("path").distinct().join(found, "path", "left").withColumn(
        "matches", F.coalesce("matches", F.array().cast("array<string>"))
    ).orderBy("path")


def diff(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    """Every source path, in order, with the first kind that hits (``tier``, null: none) and that kind's paths."""
    first = _hits(src, dest, exact).groupBy("path").agg(F.min("kind").alias("tier"), F.min_by("paths", "kind").alias("matches"))
    return src.select("path").distinct().join(first, "path", "left").orderBy("path")


def diff_classes(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    """As diff with the class (``hash``, ``n_paths``) in place of its paths."""
    first = find_classes(src, dest, exact).groupBy("path").agg(F.min_by(F.struct(F.col("kind").alias("tier"), "hash", "n_paths"), "kind").alias("x"))
    return src.select("path").distinct().join(first, "path", "left").select("path", "x.tier", "x.hash", "x.n_paths").orderBy("path")


def diff_tiers(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    """As diff without the paths, from keys alone."""
    keys = melted(dest, exact).select("kind", "hash").distinct()
    first = melted(src, exact).join(keys, ["kind", "hash"], "left_semi").groupBy("path").agg(F.min("kind").alias("tier"))
    return src.select("path").distinct().join(first, "path", "left")


def missing(src: DataFrame, dest: DataFrame, exact: bool = False) -> DataFrame:
    """Sorted source paths without any hit, from keys alone."""
    return diff_tiers(src, dest, exact).where("tier IS NULL").select("path").orderBy("path")


#: Paths of a chunk on average where a hash has more; a chunk of twice as many is out of all likelihood.
CHUNK = 1024


def posting_chunks(dest: DataFrame, exact: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``kind, hash, chunk, paths``: the paths of each hash in sorted lists of bounded length, numbered from 0.

    A hash with more than ``chunk`` paths is dealt over chunks by the hash of the path; others are one
    list.  Counts combine within tasks before they meet, and each chunk is a group of its own.
    """
    members = class_members(dest, exact)
    large = class_sizes(dest, exact).where(F.col("n_paths") > chunk).select("kind", "hash", F.ceil(F.col("n_paths") / chunk).alias("chunks"))
    place = F.pmod(F.xxhash64("path"), F.coalesce("chunks", F.lit(1)))
    dealt = members.join(large, ["kind", "hash"], "left").select("kind", "hash", place.cast("int").alias("chunk"), "path")
    return dealt.groupBy("kind", "hash", "chunk").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def find_chunks(src: DataFrame, dest: DataFrame, exact: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``path, kind, chunk, paths``: what each source path matches, chunk by chunk, of the hashes that are hit only."""
    hit = class_members(src, exact)
    keys = hit.select("kind", "hash").distinct()
    hit_only = melted(dest, exact).join(keys, ["kind", "hash"], "left_semi")
    wide = hit_only.select("path", *[F.when(F.col("kind") == k, F.col("hash")).alias(h) for k, h in enumerate(KINDS)])
    return hit.join(posting_chunks(wide, exact, chunk), ["kind", "hash"]).select("path", "kind", "chunk", "paths")


def first_tier_chunks(src: DataFrame, dest: DataFrame, exact: bool = False, chunk: int = CHUNK) -> DataFrame:
    """``path, tier, chunk, paths``: as diff, chunk by chunk; the tier comes from keys alone."""
    tiers = diff_tiers(src, dest, exact).where("tier IS NOT NULL")
    found = find_chunks(src, dest, exact, chunk)
    return found.join(tiers.select("path", F.col("tier").alias("kind")), ["path", "kind"]).select("path", F.col("kind").alias("tier"), "chunk", "paths")
