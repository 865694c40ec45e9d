"""Literal cases for predicates, digests, times, grids and prefixes."""

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import digests, grids, predicates
from tallyfold.operators.prefix import min_unique_prefix
from tallyfold.sources import inventory


def test_photo_names(spark):
    names = {"foo": None, "jpeg": None, ".jpg": None, "a.": None, "readme.txt": None, "cake.heic": "heic", "x.HEIF": "heic", "foo.jpeg": "jpeg",
             "foo.JPG": "jpeg", "Hello World.Jpeg": "jpeg", "a.jfif": "jpeg", "a.jpg\n": None}
    df = spark.createDataFrame([(f"/d/{n}",) for n in names], "path string")
    got = {r["path"][3:]: r["f"] for r in df.select("path", predicates.photo_format(F.col("path")).alias("f")).collect()}
    assert got == names


def test_candidate_size_limit(spark):
    df = spark.createDataFrame([("/a.jpg", 40_000_000), ("/a.jpg", 40_000_001), ("/._a.jpg", 1), ("/a.png", 1)], "path string, size long")
    assert [r[0] for r in df.select(predicates.may_have_metadata(F.col("path"), F.col("size"))).collect()] == [True, False, False, False]


def test_ignore_globs(spark):
    df = spark.createDataFrame([(f"/x/{n}",) for n in (".picasa.ini", "._IMG_0012.JPG", "IMG_0012.JPG", "album.picasa.ini")], "path string")
    assert [r[0] for r in predicates.ignore_names(df).collect()] == ["/x/IMG_0012.JPG", "/x/album.picasa.ini"]
    assert predicates.ignore_names(df, ["[!.]*"]).count() == 2
    assert predicates.ignore_names(df, ["{a,I}*"]).count() == 2
    assert predicates.ignore_names(df, []).count() == 4
    with pytest.raises(ValueError):
        predicates.ignore_names(df, ["["])


def test_u63(spark):
    values = [0, 2**63 - 1, 2**63, 2**64 - 1, -1]
    df = spark.createDataFrame([(str(v),) for v in values], "s string").select(F.col("s").cast("decimal(20,0)").alias("v"))
    got = [r["range_error"] for r in predicates.check_u63(df, ["v"]).collect()]
    assert [x is None for x in got] == [True, True, False, False, False]


def test_times(spark):
    df = spark.createDataFrame([(0,), (-100,), (-1000,), (1999,)], "ns long")
    assert [r[0] for r in df.select(predicates.mtime_micros(F.col("ns"))).collect()] == [0, -1, -1, 1]
    assert spark.range(1).select(predicates.filetime_to_ns(F.lit(predicates.FILETIME_EPOCH - 1))).first()[0] == -100


def test_relative_path_by_component(spark):
    df = spark.createDataFrame([("/a/b/c",), ("/a/bc/d",), ("/a/b",)], "p string")
    assert [r[0] for r in df.select(predicates.relative_to(F.col("p"), "/a/b")).collect()] == ["c", None, None]


def _hash(prefix):
    return prefix + "0" * (64 - len(prefix))


@pytest.mark.parametrize("hashes, n", [([], 0), (["00"], 1), (["00", "10"], 1), (["00", "01"], 2), (["abc0", "abc1", "ff"], 4), (["00", "00"], 1)])
def test_min_unique_prefix(spark, hashes, n):
    df = spark.createDataFrame([(_hash(h),) for h in hashes], "h string")
    assert min_unique_prefix(df, "h").first()["n"] == n


def test_upsert_replaces_whole_rows_and_is_idempotent(spark):
    current = spark.createDataFrame([("h1", 10, 20), ("h2", 1, 1)], "content_hash string, width int, height int")
    updates = spark.createDataFrame([("h1", None, None, 1), ("h1", 5, None, 2), ("h3", 7, 7, 1)], "content_hash string, width int, height int, seq int")
    once = inventory.upsert(current, updates, ["content_hash"], "seq")
    want = {("h1", 5, None), ("h2", 1, 1), ("h3", 7, 7)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in inventory.upsert(once, updates, ["content_hash"], "seq").collect()} == want


def test_index_round_trip(spark, tmp_path):
    index = inventory.Index(
        spark.createDataFrame([("test", 10, 20, 0, "h")], "path string, inode long, size long, mtime_ns long, content_hash string"),
        spark.createDataFrame([("h", None, None, None, None)], "content_hash string, width int, height int, rothash string, blockhash string"),
        spark.createDataFrame([("h", "m", None, None)], "content_hash string, md5 string, sha1 string, sha256 string"),
    )
    back = inventory.read_index(spark, inventory.write_index(index, str(tmp_path)))
    for name in ("files", "images", "extra"):
        assert getattr(back, name).collect() == getattr(index, name).collect()


def test_inventory_of_a_folder(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"hello world")
    (tmp_path / "b").write_bytes(b"x")
    rows = {r["path"]: r for r in inventory.read_inventory(spark, [str(tmp_path)], content=True).collect()}
    assert {p: r["size"] for p, r in rows.items()} == {str(tmp_path / "d" / "a.txt"): 11, str(tmp_path / "b"): 1}
    df = digests.with_digests(inventory.read_inventory(spark, [str(tmp_path / "d")], content=True), "content")
    assert df.first()["md5"] == "5eb63bbbe01eeed093cb22bb8f5acdc3"
    assert predicates.kib(F.col("size")) is not None


def test_manifest_refuses_bad_outputs(spark):
    df = spark.createDataFrame([("/s/a",), ("/t/b",)], "path string")
    with pytest.raises(ValueError):
        inventory.transfer_manifest(df, "/s", {})
    with pytest.raises(ValueError):
        inventory.transfer_manifest(df, "/s", {"copy": "/s/out"})
    rows = inventory.transfer_manifest(df, "/s", {"copy": "/o"}).collect()
    assert [(r["out_path"], r["error"]) for r in rows] == [("/o/a", None), (None, "not relative to source")]


def test_read_stable_gives_up_after_three_tries(spark):
    todo = spark.createDataFrame([("still",), ("moving",)], "path string")
    calls = []

    def read(paths):
        calls.append(1)
        before = paths.select("path", F.lit(1).alias("inode"), F.lit(1).alias("size"), F.lit(0).alias("mtime_ns"))
        after = before.withColumn("size", F.when(F.col("path") == "moving", 2).otherwise(1))
        return before, paths.withColumn("h", F.lit("x")), after

    done, left = digests.read_stable(todo, read)
    assert [r["path"] for r in done.collect()] == ["still"] and [r["path"] for r in left.collect()] == ["moving"] and len(calls) == 3


def test_grid_hashes(spark):
    df = spark.createDataFrame([(3, 2, [1, 2, 3, 4, 5, 6])], "width int, height int, values array<int>")
    turned = grids.apply_orientation(df.withColumn("transform", F.lit("rot90"))).first()
    assert (turned["width"], turned["height"], turned["values"]) == (2, 3, [4, 1, 5, 2, 6, 3])
    for kind in grids.TRANSFORMS.values():
        other = grids.apply_orientation(df.withColumn("transform", F.lit(kind)))
        same = df.select(grids.rothash()).first()[0] == other.select(grids.rothash()).first()[0]
        assert same == (kind in ("none", "rot90", "rot180", "rot270"))


def test_block_hash_helper_equals_columns(spark):
    df = spark.createDataFrame([(8, 8, [(i * 37 + i * i) % 256 for i in range(64)]), (8, 8, [7] * 64)], "width int, height int, values array<int>")
    rows = df.select(grids.cell_bits(brightest=255).alias("a"), grids.blockhash(8, 255)("values", "width", "height").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)
    assert len(grids.block_bits(list(range(35 * 21)), 35, 21, 16)) == 256


def test_orientation_last_with_value_wins(spark):
    rows = [("a", 1, "Orientation", [6]), ("a", 2, "Orientation", []), ("b", 1, "Other", [3]), ("c", 1, "Orientation", [3]), ("c", 2, "Orientation", [9])]
    df = spark.createDataFrame(rows, "path string, seq int, tag string, value array<int>")
    assert {r["path"]: r["transform"] for r in grids.orientation_transform(df).collect()} == {"a": "rot90", "b": "none", "c": "none"}
