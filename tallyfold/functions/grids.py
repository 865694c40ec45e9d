"""Image hashes on decoded brightness grids (``width``, ``height``, ``values``: row by row)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orientation number and what it does; any other number does nothing.
TRANSFORMS = {1: "none", 2: "hflip", 3: "rot180", 4: "vflip", 5: "transpose", 6: "rot90", 7: "transverse", 8: "rot270"}
TURNED = ("transpose", "rot90", "transverse", "rot270")
#: Largest brightness of a cell: red + green + blue.
BRIGHTEST = 765
BANDS = 4


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda, a plain column expression would be
    worked out again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _permuted(values: Column, width: Column, height: Column, kind: str) -> Column:
    """The grid after a transform, by picking the source cell of each cell."""
    if kind == "none":
        return values
    across = height if kind in TURNED else width  # width of the result

    def source(i: Column, cells: Column) -> Column:
        r, c = (i / across).cast("int"), i % across
        row, col = {
            "hflip": (r, width - 1 - c), "rot180": (height - 1 - r, width - 1 - c), "vflip": (height - 1 - r, c), "transpose": (c, r),
            "rot90": (height - 1 - c, r), "transverse": (height - 1 - c, width - 1 - r), "rot270": (c, width - 1 - r),
        }[kind]
        return F.element_at(cells, (row * width + col + 1).cast("int"))

    def all_cells(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: source(i, v))).otherwise(v)

    return _once(values, all_cells)


def grid_digest(values: Column) -> Column:
    """SHA-256 of the cells as two-digit hex numbers one after the other."""
    return F.sha2(F.array_join(F.transform(values, lambda x: F.format_string("%02x", x)), ""), 256)


def rothash(values: str = "values", width: str = "width", height: str = "height") -> Column:
    """Smallest digest of the grid in its four rotations; mirror images differ."""
    v, w, h = F.col(values), F.col(width), F.col(height)
    return F.array_min(F.array(*[grid_digest(_permuted(v, w, h, k)) for k in ("none", "rot90", "rot180", "rot270")]))


def cell_bits(values: str = "values", brightest: int = BRIGHTEST) -> Column:
    """Block-mean hash of a grid whose cells are the blocks: a bit for each cell, set if it is above the
    median of its band of rows; near the median only if that is above half of the brightest."""
    def hashed(v: Column) -> Column:
        band = (F.size(v) / BANDS).cast("int")

        def median(b: int) -> Column:
            part = F.array_sort(F.slice(v, F.lit(b) * band + 1, band))
            n = F.size(part)
            return (F.element_at(part, ((n + 1) / 2).cast("int")) + F.element_at(part, (n / 2).cast("int") + 1)) / 2

        def bits(known: Column) -> Column:
            def bit(x: Column, i: Column) -> Column:
                m = F.element_at(known["medians"], F.least((i / known["band"]).cast("int"), F.lit(BANDS - 1)) + 1)
                return F.when((x > m) | ((F.abs(x - m) < 1) & (m > brightest / 2)), "1").otherwise("0")

            return F.array_join(F.transform(v, bit), "")

        return _once(F.struct(F.array(*[median(b) for b in range(BANDS)]).alias("medians"), band.alias("band")), bits)

    return _once(F.col(values), hashed)


def block_bits(values: np.ndarray, width: int, height: int, n: int, brightest: int = BRIGHTEST) -> str:
    """The same for a picture: cells are summed in n by n blocks (edges by share of the cell)."""
    grid = np.asarray(values, dtype=float).reshape(height, width)

    def shares(size: int) -> np.ndarray:
        edges = np.linspace(0, size, n + 1)
        cell = np.arange(size)
        return np.clip(np.minimum(edges[1:, None], cell + 1) - np.maximum(edges[:-1, None], cell), 0, 1)

    blocks = (shares(height) @ grid @ shares(width).T).ravel()
    half = brightest * (width / n) * (height / n) / 2
    bands = blocks.reshape(BANDS, -1)
    medians = np.repeat(np.median(bands, axis=1), bands.shape[1])
    return "".join("1" if b > m or (abs(b - m) < 1 and m > half) else "0" for b, m in zip(blocks, medians))


def blockhash(n: int = 16, brightest: int = BRIGHTEST):
    """Vectorized helper for picture-size grids: (values, width, height) -> bits.  Use small Arrow batches."""

    @F.pandas_udf("string")
    def bits(values: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or not w or not h else block_bits(v, int(w), int(h), n, brightest) for v, w, h in zip(values, width, height)])

    return bits


def turned_digest(values: np.ndarray, width: int, height: int) -> str:
    """Smallest digest of a picture in its four rotations, as :func:`rothash` has it."""
    grid = np.asarray(values, dtype=np.int64).reshape(height, width)
    small = grid.size == 0 or 0 <= grid.min() and grid.max() < 256

    def digest(turned: np.ndarray) -> str:
        text = turned.astype(np.uint8).tobytes().hex() if small else "".join(map("{:02x}".format, turned.ravel().tolist()))
        return hashlib.sha256(text.encode()).hexdigest()

    return min(digest(np.rot90(grid, k)) for k in range(4))


def picture_rothash():
    """Vectorized helper for picture-size grids: (values, width, height) -> digest.  Use small Arrow batches.  Null where a part is
    null or the sizes do not fit."""

    @F.pandas_udf("string")
    def smallest(values: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        fits = lambda v, w, h: v is not None and not pd.isna(w) and not pd.isna(h) and len(v) == w * h
        return pd.Series([turned_digest(v, int(w), int(h)) if fits(v, w, h) else None for v, w, h in zip(values, width, height)])

    return smallest


def orientation_transform(fields: DataFrame) -> DataFrame:
    """``path`` and ``transform``: the last Orientation field with a value wins, else none."""
    with_value = (F.col("tag") == "Orientation") & (F.size("value") > 0)
    names = F.create_map(*[F.lit(x) for kv in TRANSFORMS.items() for x in kv])
    last = F.max_by(F.when(with_value, F.col("value")[0]), F.when(with_value, F.col("seq")))
    return fields.groupBy("path").agg(last.alias("__n")).select("path", F.coalesce(F.try_element_at(names, F.col("__n").cast("int")), F.lit("none")).alias("transform"))


def apply_orientation(df: DataFrame, transform: str = "transform") -> DataFrame:
    """Grids turned as the transform says; width and height swap on quarter turns."""
    v, w, h, t = F.col("values"), F.col("width"), F.col("height"), F.col(transform)
    out = v
    for kind in list(TRANSFORMS.values())[1:]:
        out = F.when(t == kind, _permuted(v, w, h, kind)).otherwise(out)
    turned = t.isin(*TURNED)
    # In one step, names inside a lambda would be taken for the new width and height.
    done = df.withColumn("values", out).withColumns({"__width": F.when(turned, h).otherwise(w), "__height": F.when(turned, w).otherwise(h)})
    return done.withColumns({"width": F.col("__width"), "height": F.col("__height")}).drop("__width", "__height")


def image_records(df: DataFrame) -> DataFrame:
    """Image rows from ``content_hash, format, decode_ok, width, height, rothash, blockhash``: no rotation hash
    for HEIC; a failed decode is a row with nothing but its key."""
    ok = F.col("decode_ok")
    return df.where("format IS NOT NULL").select(
        "content_hash", F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"),
        F.when(ok & (F.col("format") == "jpeg"), F.col("rothash")).alias("rothash"), F.when(ok, F.col("blockhash")).alias("blockhash"),
    )
