"""Work that must hold for hot hashes, long common prefixes and failures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold import queries
from tallyfold.functions import grids, predicates
from tallyfold.operators import audit, index, match, seen
from tallyfold.operators.prefix import hash_neighbours, min_unique_by_halving, min_unique_prefix
from tallyfold.plans import commands
from tallyfold.plans import fixtures as fx
from tallyfold.sources.shared import cut

SF = "/root/testdata/sf0.001"
SIDE = "path string, h0 string, h1 string, h2 string, error string"


def test_commands_stop_at_the_first_failure(spark):
    """Each ends with the path of the failed file, whichever side it is on; the plain operators and the index go on."""
    sound = spark.createDataFrame([("/s", "x", None, None, None), ("/t", "y", None, None, None)], SIDE)
    bad = spark.createDataFrame([("/s", "x", None, None, None), ("/broken", None, None, None, "io error")], SIDE)
    for command in (commands.find, commands.diff, commands.missing):
        for src, dest in ((bad, sound), (sound, bad)):
            with pytest.raises(Exception, match="/broken: io error"):
                command(src, dest).collect()
        assert command(sound, sound).count() == (0 if command is commands.missing else 2)
    assert match.find_matches(bad, sound).count() == 2
    files = spark.createDataFrame([("/s", 1, 1, 1, "x")], "path string, inode long, size long, mtime_ns long, content_hash string")
    images = spark.createDataFrame([("x", None, None, None, None)], "content_hash string, width int, height int, rothash string, blockhash string")
    observed = "path string, content_hash string, decode_ok boolean, width int, height int, rothash string, blockhash string, error string"
    unrecorded = spark.createDataFrame([("/s", "z", True, None, None, None, None, None), ("/nobody", None, None, None, None, None, None, "io error")], observed)
    assert [r["reason"] for r in commands.validate(unrecorded, files, images).collect()] == [audit.HASH_MISMATCH]
    recorded = spark.createDataFrame([("/s", None, None, None, None, None, None, "io error")], observed)
    with pytest.raises(Exception, match="/s: io error"):
        commands.validate(recorded, files, images).collect()
    content = spark.createDataFrame([("/a.jpg", 1, "x", None), ("/b.jpg", 1, None, "io error")], "path string, size long, content_hash string, error string")
    redecoded = spark.createDataFrame([("/a.jpg", False, "bad")], "path string, ok boolean, cause string")
    with pytest.raises(Exception, match="/b.jpg: io error"):
        commands.broken(content, images, redecoded).collect()
    assert commands.broken(content.where("error IS NULL"), images, redecoded).count() == 1


def test_only_possible_hits_are_looked_up(spark):
    known = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    batch = spark.range(1000, 6000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash")).unionByName(spark.createDataFrame([(None,)], "content_hash string"))
    first, second = (seen.seen_filter(known.where(F.left("content_hash", F.lit(1)) < "8")), seen.seen_filter(known.where(F.left("content_hash", F.lit(1)) >= "8")))
    merged = seen.merge_filters(first, second)
    told = seen.possibly_seen(batch, merged)
    hits = {r["content_hash"] for r in told.where("possible").collect()}
    true = {r["content_hash"] for r in known.collect()} & {r["content_hash"] for r in batch.collect()}
    assert true <= hits and len(true) == 1000 and len(hits) < 1010  # about 2000 / 2^24 of the new ones
    got = seen.first_seen(batch, known, merged).collect()
    assert len(got) == 4000 and not {r["content_hash"] for r in got} & true
    # A filter that is full lets everything through; results stay.
    small = seen.seen_filter(known, bits=15)
    assert seen.possibly_seen(batch, small, bits=15).where("possible").count() > 1100
    assert seen.first_seen(batch, known, small, bits=15).count() == 4000
    assert seen.first_seen(batch, known.where("false"), seen.seen_filter(known.where("false"))).count() == 5000
    with pytest.raises(ValueError):
        seen.seen_filter(known, bits=40)


def test_filtered_sight_equals_the_stream(spark):
    rows = lambda name: sorted(r["content_hash"] for r in queries.QUERIES[name](spark, SF).collect())
    assert rows("q_first_seen_filtered") == rows("q_stream_first_seen")


def test_neighbours_in_the_order_of_all(spark):
    hashes = [f"{'ab' * 10}{k * 7919 % 100003:06x}" for k in range(3000)] + ["00", "ff", "ff", None]
    df = spark.createDataFrame([(h,) for h in hashes], "h string").repartition(5)
    once = sorted({h for h in hashes if h})
    got = {r["hash"]: (r["previous"], r["common"]) for r in hash_neighbours(df, "h").collect()}
    assert got == {h: (g, len(os.path.commonprefix([g, h])) if g else 0) for g, h in zip([None, *once], once)}
    assert hash_neighbours(df.where("false"), "h").count() == 0
    plan = hash_neighbours(df, "h")._jdf.queryExecution().executedPlan().toString()
    assert all("[range" in line for line in plan.splitlines() if " Window [" in line)  # none over all rows
    # Ranges without a row between others.
    few = spark.createDataFrame([("a",), ("b",)], "h string")
    assert {r["hash"]: r["previous"] for r in hash_neighbours(few, "h").collect()} == {"a": None, "b": "a"}


def test_shortest_prefix_by_halving(spark):
    pad = lambda *x: [h.ljust(64, "0") for h in x]
    cases = {0: [], 1: pad("00"), 2: pad("00", "01"), 4: pad("abc0", "abc1", "ff")}
    cases[21] = [f"{'5' * 20}{k:x}{'0' * 43}" for k in range(16)] + [None]  # all begin alike
    cases[64] = ["7" * 63 + d for d in "01"]
    for want, hashes in cases.items():
        df = spark.createDataFrame([(h,) for h in hashes], "h string")
        assert min_unique_by_halving(df, "h").first()["n"] == want == min_unique_prefix(df, "h").first()["n"]
    assert min_unique_by_halving(spark.createDataFrame([(h,) for h in pad("00", "10")], "h string"), "h").first()["n"] == 1
    assert min_unique_by_halving(spark.createDataFrame([(pad("00")[0],)] * 2, "h string"), "h").first()["n"] == 1


def test_lists_of_a_hot_hash_are_bounded(spark):
    n = 5000
    rows = [(f"/hot/{i}", "h", None, "b") for i in range(n)] + [("/one", "x", "r", None)]
    df = spark.createDataFrame(rows, "path string, h0 string, h1 string, h2 string").repartition(7)
    chunks = match.posting_chunks(df.unionByName(df), chunk=100).collect()
    assert max(len(r["paths"]) for r in chunks) < 200 and all(r["paths"] == sorted(set(r["paths"])) for r in chunks)
    hot = [p for r in chunks if r["hash"] == "h" for p in r["paths"]]
    assert len(hot) == n == len(set(hot)) and sum(r["hash"] == "h" for r in chunks) == 50
    asked = df.where("path IN ('/hot/1', '/one')")
    found = match.find_chunks(asked, df, chunk=100).collect()
    assert sum(len(r["paths"]) for r in found) == 2 * n + 2 and max(len(r["paths"]) for r in found) < 200
    first = match.first_tier_chunks(asked, df, chunk=100).collect()
    assert {r["tier"] for r in first} == {0} and sum(len(r["paths"]) for r in first) == n + 1
    assert match.find_chunks(asked, df, exact=True, chunk=100).where("kind > 0").count() == 0


def test_counters_come_with_the_results(spark, tmp_path):
    flagged = cut(index.computed_flags(queries._classified(spark, SF), fx.images_tbl(spark, SF)), "flagged")
    want = index.index_summary(flagged).first()
    records, counters = index.counted(flagged)
    records.write.parquet(f"{tmp_path}/records")
    got = counters.get
    assert (got["files"], got["computed"], got["reused"]) == (want["files"], want["computed"], want["reused"]) and got["images"] == flagged.where("image_computed").count()
    assert records._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    failures, told = audit.counted_failures(queries._failures(spark, SF))
    failures.write.format("noop").mode("overwrite").save()
    by_reason = {r["reason"]: r["n"] for r in audit.failure_counts(queries._failures(spark, SF)).collect()}
    assert told.get == {"total": sum(by_reason.values()), **{r: by_reason.get(r, 0) for r in audit.REASONS}}


def test_picture_rothash(spark):
    """Equal to the column version; the same for quarter turns, another for mirror images; sizes that do not fit give null."""
    pictures = fx.pictures(spark, SF).limit(40)
    both = pictures.select(grids.rothash().alias("a"), grids.picture_rothash()("values", "width", "height").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
    eight = fx.grids_src(spark, SF).select(grids.rothash().alias("a"), grids.picture_rothash()("values", "width", "height").alias("b"))
    assert eight.where("a <> b OR b IS NULL").count() == 0
    rng = np.random.default_rng(1)
    for top in (256, 766):
        grid = rng.integers(0, top, size=(120, 90))
        digests = {grids.turned_digest(np.rot90(grid, k).ravel(), *reversed(np.rot90(grid, k).shape)) for k in range(4)}
        assert len(digests) == 1 and grids.turned_digest(np.fliplr(grid).ravel(), 90, 120) not in digests
    odd = spark.createDataFrame([([1, 2], 1, 1), (None, 1, 1), ([1], None, 1), ([], 0, 0), ([700], 1, 1)], "values array<int>, width int, height int")
    assert [r[0] is None for r in odd.select(grids.picture_rothash()("values", "width", "height")).collect()] == [True, True, True, False, False]


def test_fields_with_their_directory(spark):
    df = spark.createDataFrame([(1, '{"0":{"Orientation":"6","Make":"x"},"1":{"Orientation":"1"}}'), (2, "{}"), (3, None)], "k int, j string")
    got = sorted(map(tuple, predicates.explode_directories(df, "j", ["k"]).collect()))
    assert got == [(1, "Make", "0", "x"), (1, "Orientation", "0", "6"), (1, "Orientation", "1", "1")]
