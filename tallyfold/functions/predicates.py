"""Row predicates and small column functions on paths, sizes and times."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_IGNORE = (".picasa.ini", "._*")
LARGEST_PHOTO = 40_000_000
JPEG_EXTENSIONS = ("jpg", "jpeg", "jpe", "jif", "jfif", "jfi")
HEIC_EXTENSIONS = ("heif", "heic")
#: 100-nanosecond steps between 1601 and 1970.
FILETIME_EPOCH = 116_444_736_000_000_000


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ``*``, ``?``, ``[...]``, ``[!...]`` and ``{a,b}``.

    A bad glob raises ValueError before any data is read.
    """
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed character class in glob {pattern!r}")
            body = pattern[i:end]
            negated = body[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out += f"[{'^' if negated else ''}{inner}]"
            i = end + 1
        elif c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        elif c == "\\":
            if i == len(pattern):
                raise ValueError(f"glob {pattern!r} ends with a backslash")
            out += re.escape(pattern[i])
            i += 1
        else:
            out += re.escape(c)
    if depth:
        raise ValueError(f"unclosed alternatives in glob {pattern!r}")
    return out


def ignored(path: Column, patterns=DEFAULT_IGNORE) -> Column:
    """Whether the file name matches one of the globs as a whole (case matters)."""
    if not patterns:
        return F.lit(False)
    return file_name(path).rlike(r"(?s)\A(?:" + "|".join(map(glob_regex, patterns)) + r")\z")


def ignore_names(df: DataFrame, patterns=DEFAULT_IGNORE, path: str = "path") -> DataFrame:
    """Rows whose file name matches none of the globs; folder names are not looked at."""
    return df.where(~ignored(F.col(path), patterns))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listing rows that were read, and those that failed."""
    return df.where("error IS NULL"), df.where("error IS NOT NULL")


def stop_at_failure(df: DataFrame, error: str = "error", path: str = "path") -> DataFrame:
    """The rows, none of which may have failed: the query ends with the path and the error of the first such row that a task
    meets."""
    told = F.raise_error(F.concat_ws(": ", path, error)).cast("boolean")
    return df.where(F.when(F.col(error).isNull(), True).otherwise(told))


def photo_format(path: Column) -> Column:
    """``jpeg``, ``heic`` or null, by the extension in any case; the stem may not be empty."""
    name = file_name(path)

    def has(extensions) -> Column:
        return name.rlike(r"(?is)\A.+\.(?:" + "|".join(extensions) + r")\z")

    return F.when(has(JPEG_EXTENSIONS), "jpeg").when(has(HEIC_EXTENSIONS), "heic")


def may_have_metadata(path: Column, size: Column) -> Column:
    """Whether a file is worth decoding: a photo by name, not too large, no resource fork."""
    return ~file_name(path).startswith("._") & (size <= LARGEST_PHOTO) & photo_format(path).isNotNull()


def changed_only(df: DataFrame) -> DataFrame:
    """Rows whose content or image data was computed in this run; further digests alone don't count."""
    return df.where("hash_computed OR image_computed")


def check_u63(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``range_error``: the first column whose value is negative or over 2^63 - 1, else null."""
    wide = [F.col(c).cast("decimal(20,0)") for c in columns]
    bad = [F.when((w < 0) | (w > F.lit(2**63 - 1).cast("decimal(20,0)")), F.lit(f"{c} out of range")) for c, w in zip(columns, wide, strict=True)]
    return df.withColumn("range_error", F.coalesce(*bad, F.lit(None).cast("string")))


def mtime_micros(ns: Column) -> Column:
    """Whole microseconds since 1970, rounded down also before it."""
    down = (ns - F.pmod(ns, F.lit(1000).cast("long"))).cast("decimal(20,0)")
    return (down / F.lit(1000).cast("decimal(4,0)")).cast("long")


def mtime_to_ts(ns: Column) -> Column:
    """Timestamp for display; the nanoseconds beyond microseconds are lost."""
    return F.timestamp_micros(mtime_micros(ns))


def filetime_to_ns(filetime: Column) -> Column:
    """Nanoseconds since 1970 of a count of 100 ns since 1601."""
    return (filetime - F.lit(FILETIME_EPOCH)) * 100


def is_invalid() -> Column:
    """Whether an image row records a failed decode: a dimension is missing."""
    return F.col("width").isNull() | F.col("height").isNull()


def relative_to(path: Column, root: str) -> Column:
    """Path under the root by whole components, null if it is not under it."""
    head = root.rstrip("/") + "/"
    return F.when(path.startswith(head), F.substring(path, F.lit(len(head) + 1), F.length(path)))


def display_path(path: Column) -> Column:
    r"""Path without a leading ``\\?\``."""
    return F.regexp_replace(path, r"\A\\\\\?\\", "")


def short_hash(digest: Column, n: int = 12) -> Column:
    return F.left(digest, F.lit(n))


def kib(size: Column) -> Column:
    """Whole KiB."""
    return F.shiftright(size, 10)


def explode_fields(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """One row for each field of a JSON object: ``keep``, ``tag``, ``value``."""
    return df.select(*keep, F.explode(F.from_json(json, "map<string,string>")).alias("tag", "value"))


def explode_directories(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """One row for each field of each directory (``ifd``) of a JSON object of objects: ``keep``, ``tag``, ``ifd``, ``value``."""
    of = df.select(*keep, F.explode(F.from_json(json, "map<string,map<string,string>>")).alias("ifd", "__fields"))
    return of.select(*keep, "ifd", F.explode("__fields").alias("tag", "value")).select(*keep, "tag", "ifd", "value")
