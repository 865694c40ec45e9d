"""Shards of near-equal bytes by sampled splitters, with DataFrame operations only.

1. Equal rows are counted, so that a row repeated any number of times is one record.
2. A size-weighted sample of keys (points per record in proportion to its bytes) gives
   quantile boundaries; records fall into the ranges between them.
3. The ranges are measured exactly; overfull ones get more boundaries from a denser
   sample of their own.  A hot key is divided further by the tie-break column.
4. Inside each range a window gives every record's exact place in the total order of
   bytes and rows; the shard follows from the place, so shards differ by no more than a
   record or a small group of equal keys.

No step sorts or counts the table in one task: windows run inside ranges, and what the
driver sees are the sample (bounded by ``ranges * points``) and one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Ranges per shard, sample points per range, and how far over the mean a range may be.
RANGES_PER_SHARD, POINTS, OVERFULL, ROUNDS = 16, 32, 2.0, 4
#: Groups of equal keys stay together up to this part of a shard.
TOGETHER = 0.02


def _literal(keys: list[tuple], types: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(k, types, strict=True))]) for k in keys])


def _range_of(bounds: list[tuple], types: list[str]) -> Column:
    """Number of boundaries not above the key, found in two steps of about the square root each."""
    key = F.struct(*[F.col(f"k{i}") for i in range(len(types))])
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(_literal([g[0] for g in groups], types), lambda b: b <= key))
    fine = F.element_at(F.array(*[_literal(g, types) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda b: b <= key)))


def _splitters(records: DataFrame, rate: dict[int, float] | float, every: int) -> list[tuple]:
    """Every ``every``-th point of a size-weighted sample of keys.  ``rate``: points per byte, by range or for all."""
    if isinstance(rate, dict):
        pairs = [x for r, v in rate.items() for x in (F.lit(r), F.lit(v))]
        records = records.where(F.col("range").isin(list(rate)))
        points_per_byte = F.element_at(F.create_map(*pairs), F.col("range"))
    else:
        points_per_byte = F.lit(rate)
    unit = F.pmod(F.xxhash64("k0", "k1", "size"), F.lit(1 << 30)) / float(1 << 30)
    points = F.floor(F.col("size") * F.col("copies") * points_per_byte + unit)
    sample = records.select("k0", "k1", points.alias("points")).where("points > 0").orderBy("k0", "k1").collect()
    out, seen, due = [], 0, every
    for row in sample:
        seen += row["points"]
        if seen >= due:
            out.append((row["k0"], row["k1"]))
            due = seen + every
    return out


def _bounds(points: set[tuple]) -> list[tuple]:
    """Boundaries in order.  The first one inside a key moves to the key's start, so that only a
    key hit twice (a hot one) is divided."""
    seen, out = set(), set()
    for k0, k1 in sorted(points, key=lambda p: (p[0] is not None, p[0], p[1] is not None, p[1])):
        out.add((k0, None if k0 not in seen else k1))
        seen.add(k0)
    return sorted(out, key=lambda p: (p[0] is not None, p[0], p[1] is not None, p[1]))


#: Copies of a row that unfold at once, and how many make their blocks be spread over tasks (a change of plan only).
COPIES, SPREAD_COPIES = 1 << 14, 1 << 18


def range_shards(df: DataFrame, key: str, tie: str, size: str, shards: int = 16) -> DataFrame:
    """Columns ``key``, ``tie``, ``size``, then ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Records are ordered by ``key`` then ``tie`` (nulls first) and cut into ``shards``
    pieces of near-equal summed ``size`` (positive numbers).  Rows with equal key stay in one
    shard unless they hold more than 2 % of it.  Rows equal in all three columns are
    interchangeable and get successive slots.  Other columns are left out; an empty table
    gives an empty result; fewer records than shards leave some shards empty.
    """
    records = cut(
        df.select(F.col(key).alias("k0"), F.col(tie).alias("k1"), F.col(size).cast("long").alias("size"))
        .groupBy("k0", "k1", "size").agg(F.count("*").alias("copies")),
        "records",
    )
    types = [records.schema["k0"].dataType.simpleString(), records.schema["k1"].dataType.simpleString()]
    total = records.agg(F.sum(F.col("size") * F.col("copies")).alias("n")).first()["n"] or 0
    mean = max(1.0, total / (shards * RANGES_PER_SHARD))
    points: set[tuple] = set(_splitters(records, POINTS / mean, POINTS)) if total else set()
    for _ in range(ROUNDS):
        bounds = _bounds(points)
        ranged = records.withColumn("range", _range_of(bounds, types).cast("int"))
        measured = {
            r["range"]: r
            for r in ranged.groupBy("range").agg(
                F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"), F.count("*").alias("records")
            ).collect()
        }
        over = {r: POINTS / mean for r, m in measured.items() if m["bytes"] > OVERFULL * mean and m["records"] > 1}
        if not over:
            break
        more = set(_splitters(ranged, over, POINTS)) - points
        if not more:
            break
        points |= more
    divided = {k0 for k0, k1 in bounds if k1 is not None}

    before_bytes, before_rows, b, n = [], [], 0, 0
    for r in range(len(bounds) + 1):
        before_bytes.append(b)
        before_rows.append(n)
        if r in measured:
            b, n = b + measured[r]["bytes"], n + measured[r]["rows"]

    def at(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range") + 1)

    # One exchange by range; both windows use its order.
    ordered = Window.partitionBy("range").orderBy("k0", "k1", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = Window.partitionBy("range", "k0")
    share = F.lit(float(total) / shards)
    hot = F.coalesce(F.col("k0").isin(list(divided)), F.lit(False)) if divided else F.lit(False)
    placed = (
        ranged.withColumn("place", at(before_bytes) + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(ordered), F.lit(0)))
        .withColumn("row", at(before_rows) + F.coalesce(F.sum("copies").over(ordered), F.lit(0)))
        .withColumn("group_place", F.min("place").over(alike))
        .withColumn("group_bytes", F.sum(F.col("size") * F.col("copies")).over(alike))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    )
    # Repeated rows unfold block by block; where one has very many, its blocks are spread first.
    if (records.agg(F.max("copies")).first()[0] or 0) > SPREAD_COPIES:
        placed = placed.repartition("row", "block")
    placed = (
        placed.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, F.least((F.col("block") + 1) * COPIES, "copies") - 1)))
        .withColumn("together", ~hot & (F.col("group_bytes") <= TOGETHER * share))
        .withColumn(
            "middle",
            F.when(F.col("together"), F.col("group_place") + F.col("group_bytes") / 2)
            .otherwise(F.col("place") + F.col("copy") * F.col("size") + F.col("size") / 2),
        )
        .select(
            "k0", "k1", "size", (F.col("row") + F.col("copy")).alias("row"),
            F.least(F.floor(F.col("middle") / share), F.lit(shards - 1)).cast("int").alias("shard"),
        )
    )
    placed = cut(placed, "placed")
    starts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard: bounded by ``shards``
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("k0").alias(key), F.col("k1").alias(tie), F.col("size").alias(size), "shard", (F.col("row") - F.col("first")).alias("slot")
    )
