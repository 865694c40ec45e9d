"""Fixed schemas of the inventory tables, kinds of hashes, and key columns."""

from pyspark.sql import types as T

CONTENT, ROTATION, BLOCK = 0, 1, 2
DIGESTS = ("md5", "sha1", "sha256")


def _schema(required: dict[str, T.DataType], optional: dict[str, T.DataType] | None = None) -> T.StructType:
    return T.StructType(
        [T.StructField(n, t, False) for n, t in required.items()] + [T.StructField(n, t, True) for n, t in (optional or {}).items()]
    )


S, L, I = T.StringType(), T.LongType(), T.IntegerType()
FILES = _schema({"path": S, "inode": L, "size": L, "mtime_ns": L, "content_hash": S})
IMAGES = _schema({"content_hash": S}, {"width": I, "height": I, "rothash": S, "blockhash": S})
EXTRA = _schema({"content_hash": S}, dict.fromkeys(DIGESTS, S))
LISTING = _schema({"path": S}, {"inode": L, "size": L, "mtime_ns": L, "error": S})
KEYS = {"files": ["path"], "images": ["content_hash"], "extra": ["content_hash"]}
INFO = ["inode", "size", "mtime_ns"]
