"""Stored against recomputed values, and listings against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.predicates import is_invalid
from ..schema import INFO
from .index import candidates

HASH_MISMATCH, FAILED_DECODE, DIMENSIONS, ROTHASH, BLOCKHASH = (
    "Blake3Mismatch", "FailedDecode", "DimensionsMismatch", "JpegRothashMismatch", "Blockhash256Mismatch",
)
LOOKS_VALID = "recorded as failed photo but looks valid now"
NO_CAUSE = "invalid photo with missing root cause"


def validate(observed: DataFrame, files: DataFrame, images: DataFrame) -> DataFrame:
    """``path`` and ``reason`` of each recorded file that does not agree; the first reason that applies.

    ``observed`` has the recomputed ``content_hash, decode_ok, width, height, rothash,
    blockhash``.  No image row, or one that records a failed decode, asks for nothing.
    Nulls are equal to nulls.
    """
    recorded = observed.alias("o").join(files.select("path", F.col("content_hash").alias("stored")).alias("f"), "path")
    image = images.select(F.col("content_hash").alias("stored"), *[F.col(c).alias(f"i_{c}") for c in ("width", "height", "rothash", "blockhash")], F.lit(True).alias("has_image"))
    joined = recorded.join(image, "stored", "left")

    def differs(*columns: str):
        return ~F.struct(*[F.col(f"o.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"i_{c}").alias(c) for c in columns]))

    fine = F.col("has_image").isNull() | F.col("i_width").isNull() | F.col("i_height").isNull()
    reason = (
        F.when(~F.col("o.content_hash").eqNullSafe(F.col("stored")), HASH_MISMATCH)
        .when(fine, None)
        .when(~F.col("o.decode_ok"), FAILED_DECODE)
        .when(differs("width", "height"), DIMENSIONS)
        .when(differs("rothash"), ROTHASH)
        .when(differs("blockhash"), BLOCKHASH)
    )
    return joined.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def failure_counts(failures: DataFrame) -> DataFrame:
    return failures.groupBy("reason").agg(F.count("*").alias("n"))


REASONS = (HASH_MISMATCH, FAILED_DECODE, DIMENSIONS, ROTHASH, BLOCKHASH)


def counted_failures(failures: DataFrame) -> tuple[DataFrame, Observation]:
    """The failures, and their number by reason and in all (``total``), filled by whoever writes them."""
    seen = Observation()
    return failures.observe(seen, F.count("*").alias("total"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]), seen


def require_clean(failures: DataFrame) -> None:
    """Raise if there is any failure; the message counts them by reason."""
    found = {r["reason"]: r["n"] for r in failure_counts(failures).collect()}
    if found:
        raise RuntimeError(f"{sum(found.values())} failures: {found}")


def broken(content: DataFrame, images: DataFrame, redecoded: DataFrame) -> DataFrame:
    """``path`` and ``verdict`` of each candidate whose image row records a failed decode, after decoding it again
    (``redecoded``: path, ok, cause)."""
    failed = images.where(is_invalid()).select("content_hash")
    return (
        candidates(content).join(failed, "content_hash", "left_semi").join(redecoded, "path", "left")
        .select("path", F.when(F.col("ok"), LOOKS_VALID).otherwise(F.coalesce("cause", F.lit(NO_CAUSE))).alias("verdict"))
    )


def _together(listings: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select("path", *INFO, F.lit(name).alias("listing")) for name, df in sorted(listings.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile_missing(listings: dict[str, DataFrame]) -> DataFrame:
    """``path`` and the sorted names of the listings that lack it (``missing_in``)."""
    names = F.array(*[F.lit(n) for n in sorted(listings)])
    return (
        _together(listings).groupBy("path").agg(F.array_sort(F.array_except(names, F.collect_set("listing"))).alias("missing_in"))
        .where(F.size("missing_in") > 0)
    )


def reconcile_differences(listings: dict[str, DataFrame]) -> DataFrame:
    """``path, listing, field`` for each value unlike that of the first listing (by name) that has the path."""
    rows = F.sort_array(F.collect_list(F.struct("listing", *INFO)))
    grouped = _together(listings).groupBy("path").agg(rows.alias("rows"))
    base = F.col("rows")[0]
    each = grouped.select("path", base.alias("base"), F.explode(F.slice("rows", 2, len(listings))).alias("row"))
    fields = F.array_compact(F.array(*[F.when(~F.col(f"row.{c}").eqNullSafe(F.col(f"base.{c}")), F.lit(c)) for c in INFO]))
    return each.select("path", "row.listing", F.explode(fields).alias("field"))
