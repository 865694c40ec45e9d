"""Incremental index: what changed, what is still to compute, and what is known already."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.digests import ATTEMPTS, info, merge_digests, plan_digests
from ..functions.predicates import ignore_names, may_have_metadata, split_errors
from ..schema import DIGESTS
from ..sources.inventory import Index, upsert
from ..sources.shared import cut


def lookup_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The file row of each request ``(pos, path)``, in the order of ``pos``; nulls where unknown.  Each repeat of a path is
    answered."""
    return requests.join(files, "path", "left").orderBy("pos")


def classify(listing: DataFrame, files: DataFrame) -> DataFrame:
    """The listing with ``status``: new, changed, or unchanged (inode, size and time all equal), and with the
    stored ``content_hash`` of unchanged files only."""
    joined = listing.alias("l").join(files.alias("f"), "path", "left")
    same = info("l").eqNullSafe(info("f"))
    status = F.when(F.col("f.content_hash").isNull(), "new").when(same, "unchanged").otherwise("changed")
    kept = [F.col(f"l.{c}") for c in listing.columns if c not in ("path", "content_hash")]
    return joined.select("path", *kept, status.alias("status"), F.when(status == "unchanged", F.col("f.content_hash")).alias("content_hash"))


def candidates(content: DataFrame) -> DataFrame:
    return content.where(may_have_metadata(F.col("path"), F.col("size")))


def images_to_compute(content: DataFrame, images: DataFrame) -> DataFrame:
    """Distinct hashes of candidates without an image row; a row that records a failed decode counts as one."""
    todo = candidates(content).where("content_hash IS NOT NULL").select("content_hash").distinct()
    return todo.join(images.select("content_hash"), "content_hash", "left_anti")


def attach_images(content: DataFrame, images: DataFrame) -> DataFrame:
    """Image columns by content hash, for candidates only."""
    columns = [c for c in images.columns if c != "content_hash"]
    able = may_have_metadata(F.col("path"), F.col("size"))
    return content.join(images, "content_hash", "left").select(
        *[F.col(c) for c in content.columns], *[F.when(able, F.col(c)).alias(c) for c in columns]
    )


def attach_extra(classified: DataFrame, extra: DataFrame, requested: bool = True) -> DataFrame:
    """Further digests of unchanged files, if they are asked for and all three are there."""
    whole = F.lit(requested) & (F.col("status") == "unchanged")
    for d in DIGESTS:
        whole = whole & F.col(d).isNotNull()
    return classified.join(extra, "content_hash", "left").select(
        *[F.col(c) for c in classified.columns], *[F.when(whole, F.col(d)).alias(d) for d in DIGESTS]
    )


def computed_flags(classified: DataFrame, images: DataFrame) -> DataFrame:
    """Adds ``hash_computed`` (new or changed) and ``image_computed`` (a candidate without an image row)."""
    had = images.select("content_hash", F.lit(True).alias("__had"))
    return (
        classified.withColumn("hash_computed", F.col("status") != "unchanged")
        .join(had, "content_hash", "left")
        .withColumn("image_computed", may_have_metadata(F.col("path"), F.col("size")) & F.col("__had").isNull())
        .drop("__had")
    )


def index_summary(df: DataFrame) -> DataFrame:
    """Files, distinct contents, rows computed in this run and rows reused."""
    return df.agg(
        F.count("*").alias("files"), F.countDistinct("content_hash").alias("contents"),
        F.count_if(F.col("hash_computed")).alias("computed"), F.count_if(~F.col("hash_computed")).alias("reused"),
    )


def counted(records: DataFrame) -> tuple[DataFrame, Observation]:
    """The records, and the counters ``files, computed, reused, images`` that whoever writes them fills on the way: there is no
    second pass.  (Distinct contents need rows to meet: :func:`index_summary`.)"""
    seen = Observation()
    return records.observe(
        seen, F.count("*").alias("files"), F.count_if(F.col("hash_computed")).alias("computed"), F.count_if(~F.col("hash_computed")).alias("reused"), F.count_if(F.col("image_computed")).alias("images")
    ), seen


def read_contents(todo: DataFrame, digest: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows whose content could be read while it held still, and those that failed (with ``error``).

    ``digest(rows)`` adds ``content`` (the key digest) and a struct ``new`` of further ones.  It may also add ``failure``, a
    text where reading failed, and ``before`` and ``after``, the inode, size and time as found when reading began and ended:
    a row for which they differ is read again, ATTEMPTS times in all.  Each attempt is written once, so that
    whatever is made of it comes from one read.
    """
    done, failed, left = [], [], todo
    for attempt in range(ATTEMPTS):
        got = cut(digest(left), "read")
        failure = F.col("failure") if "failure" in got.columns else F.lit(None).cast("string")
        held = F.col("before").eqNullSafe(F.col("after")) if {"before", "after"} <= set(got.columns) else F.lit(True)
        done.append(got.where(failure.isNull() & held).select(*todo.columns, "content", "new"))
        failed.append(got.where(failure.isNotNull()).select(*todo.columns, failure.alias("__failure")))
        left = got.where(failure.isNull() & ~held).select(*todo.columns)
        if "after" not in got.columns or left.isEmpty():
            break
    else:
        failed.append(left.withColumn("__failure", F.lit(f"changed while it was read, {ATTEMPTS} times")))
    good, bad = reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, failed)
    return good, bad.withColumn("error", F.col("__failure")).drop("__failure")


class Run(NamedTuple):
    """What a run of the index gives: records of the files, the tables after it, and the rows that failed (``path, error``)."""

    records: DataFrame
    index: Index
    failed: DataFrame


def run_index(listing: DataFrame, index: Index, digest: Callable[[DataFrame], DataFrame], decode: Callable[[DataFrame], DataFrame], desired=DIGESTS) -> Run:
    """One run of the index: the records of all files that could be listed and read, and the three tables after it.

    Ignored names go, failed entries are told and passed over; files are classified against the index; new and
    changed ones are digested, as are unchanged ones that lack a digest asked for (see :func:`read_contents` for
    ``digest``; a row that fails is told and the run goes on).  Contents of photo candidates without an image row are decoded:
    ``decode(hashes)`` gives image rows for ``content_hash``, with nulls for a photo of no supported kind, which is recorded as such;
    it may add ``failure``, a text where decoding failed otherwise: nothing is recorded of that image, and its files are told
    as failed (their contents are recorded).  Rows already known are taken from the index, and
    what was computed replaces or joins its tables; nothing is ever removed from them.  Contents are read and
    decoded once, whatever is then done with the results.
    """
    ok, unlisted = split_errors(ignore_names(listing))
    classified = classify(ok, index.files)
    known = attach_extra(classified, index.extra, bool(desired))
    planned = plan_digests(known, desired).withColumn("read", (F.col("status") != "unchanged") | (F.size("todo") > 0))
    read, unread = read_contents(planned.where("read"), digest)
    merged = merge_digests(read.withColumn("content_hash", F.coalesce("content_hash", "content"))).select(*planned.columns)
    digested = cut(merged.unionByName(planned.where("NOT read")), "digested")
    flagged = computed_flags(digested, index.images)
    made = cut(decode(images_to_compute(flagged, index.images)), "decoded")
    failed = unlisted.select("path", "error").unionByName(unread.select("path", "error"))
    if "failure" in made.columns:
        undecoded = made.where("failure IS NOT NULL").select("content_hash", F.col("failure").alias("__failure"))
        lost = flagged.where("image_computed").join(undecoded, "content_hash").select("path", F.col("__failure").alias("error"))
        failed = failed.unionByName(lost)
        flagged = flagged.join(lost.select("path"), "path", "left_anti")
        made = made.where("failure IS NULL")
    images = index.images.unionByName(made.select(*index.images.columns))
    records = attach_images(flagged, images)
    once = F.lit(1)
    files = upsert(index.files, digested.where("status <> 'unchanged'").select(*index.files.columns, once.alias("seq")), ["path"], "seq")
    more = digested.where("read AND store_extra").select(*index.extra.columns).dropDuplicates(["content_hash"]).withColumn("seq", once)
    return Run(records, Index(files, images, upsert(index.extra, more, ["content_hash"], "seq")), failed)
