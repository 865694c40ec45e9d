"""The index over runs and batches: versions, deltas, ties, hot contents, display."""

import datetime
import hashlib
import os
import re

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold import queries
from tallyfold.functions import digests, predicates
from tallyfold.operators import index, match
from tallyfold.plans import fixtures as fx
from tallyfold.sources import inventory, listing, shared
from tallyfold.streaming import index_stream

SF = "/root/testdata/sf0.001"


def test_index_versions_round_trip(spark, tmp_path):
    before = inventory.Index(fx.files_old(spark, SF), fx.images_tbl(spark, SF), fx.extra_tbl(spark, SF))
    first = inventory.write_index(before, str(tmp_path))
    read = inventory.read_index(spark, first)
    for name in ("files", "images", "extra"):
        assert sorted(getattr(read, name).collect(), key=str) == sorted(getattr(before, name).select(*inventory.SCHEMAS[name].names).collect(), key=str)
    assert inventory.write_index(read, str(tmp_path)) != first and inventory.read_index(spark, first).files.count() == before.files.count()


def test_ready_listing_keeps_hidden_empty_and_failed_entries(spark, tmp_path):
    rows = [("/a/.hidden", 1, 0, 5, None), ("/a/_odd", 2, 3, -1, None), ("/a/gone", None, None, None, "io error")]
    spark.createDataFrame(rows, inventory.LISTING).write.parquet(f"{tmp_path}/listing")
    assert sorted(map(tuple, inventory.read_listing(spark, f"{tmp_path}/listing").collect())) == sorted(rows)


def test_latest_rows_do_not_hang_on_how_rows_come(spark):
    rows = [("a", k, 7) for k in range(50)] + [("b", 1, 1), ("b", 2, None), (None, 3, 1)]
    df = spark.createDataFrame(rows, "path string, value long, seq long")
    got = {tuple(map(tuple, inventory.latest_rows(df.repartition(n), ["path"], "seq").orderBy("path").collect())) for n in (1, 3, 7)}
    assert len(got) == 1 and {r[0] for r in next(iter(got))} == {"a", "b", None}
    assert inventory.latest_rows(df.where("false"), ["path"], "seq").count() == 0


LISTED = "path string, inode long, size long, mtime_ns long, error string, text string"


def _stream(spark, folder):
    return spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_index_stream_over_ten_batches_and_a_replay(spark, tmp_path):
    """Each batch against the state of its own paths; a batch that is run again, as after a failure between its writes and
    its commit, gives equal rows."""
    want, changes, last = {"/old": (9, 9, 9, "kept"), "/p0": (1, 0, 0, "seed")}, [], []
    for k in range(10):
        rows = [(f"/p{i}", 1, k // (i + 1), 0, "bad" if (i + k) % 7 == 6 else None, "") for i in range(5)]
        if k == 9:
            rows.append(("/late", 1, 2, 3, None, ""))
        spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for path, *info, error, _ in rows:
            if error is None and want.get(path, ())[:3] != tuple(info):
                changes.append((k, path, "changed" if path in want else "new"))
                want[path] = (*info, f"{path}:{info[1]}")
    index = spark.createDataFrame([(p, *v) for p, v in (("/old", (9, 9, 9, "kept")), ("/p0", (1, 0, 0, "seed")))], inventory.FILES)

    def run():
        digest = lambda row: f"{row['path']}:{row['size']}"
        index_stream.start(index_stream.index_stream(_stream(spark, tmp_path), digest, index), f"{tmp_path}/out").awaitTermination()
        state = {r["path"]: (r["inode"], r["size"], r["mtime_ns"], r["content_hash"]) for r in index_stream.current_rows(spark, f"{tmp_path}/out").collect()}
        told = sorted((r["batch"], r["path"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out/changes").collect())
        return state, told

    first = run()
    assert first == (want, sorted(changes))
    assert any(c[0] == 9 for c in changes)
    for gone in (tmp_path / "out/state/commits").glob("*9*"):
        gone.unlink()
    assert run() == first
    assert run() == first  # nothing new


def test_one_hand_over_serves_many_keys(spark):
    """A bucket's keys come in one call, each with its own state; of a key's rows in a batch the last in order counts."""
    asked = []

    class Held(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        def getMapState(self, name, keys, fields):
            assert (name, keys.names, fields.names) == ("row", ["path"], ["seq"])
            return Held({("/b",): (7,)})

    def decide(old, row):
        asked.append((row["path"], old))
        return None if old == (row["seq"],) else (row["seq"],)

    kept = index_stream.KeyedRows(T.StructType().add("path", "string"), T.StructType().add("seq", "long"), decide, lambda row: row["seq"])
    kept.init(Handle())
    kept.handleInitialState((3,), Row(path="/c", seq=1), None)
    rows = [Row(path=p, seq=n) for p, n in (("/a", 2), ("/b", 7), ("/a", 5), ("/a", 4), ("/c", 2), (None, 1))]
    assert [tuple(r) for r in kept.handleInputRows((3,), iter(rows), None)] == [("/a", 5), ("/c", 2), (None, 1)]
    assert asked == [("/a", None), ("/b", (7,)), ("/c", (1,)), (None, None)]
    assert kept.rows == {("/a",): (5,), ("/b",): (7,), ("/c",): (2,), (None,): (1,)}


def test_latest_of_a_stream(spark, tmp_path):
    rows = [("a", 1, 1.0), ("a", 3, 3.0), ("a", 2, 2.0), ("b", None, 7.0), (None, 5, 5.0)]
    schema = "path string, seq long, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("a", 2, 9.0), ("b", 1, 8.0), ("c", 1, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    index_stream.start(index_stream.latest_stream(stream, ["path"], "seq"), f"{tmp_path}/out").awaitTermination()
    got = {r["path"]: (r["seq"], r["value"]) for r in index_stream.current_rows(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (3, 3.0), "b": (1, 8.0), None: (5, 5.0), "c": (1, 1.0)}


def test_a_second_run_computes_nothing(spark):
    after = queries._index_run(spark, SF).index
    listing = fx.docs_files(spark, SF).select("doc_id", "path", "inode", "size", "mtime_ns", "error")

    def never(rows):
        assert rows.isEmpty()
        return rows.withColumns({"content": F.lit("x"), "new": F.struct(*[F.lit("x").alias(d) for d in index.DIGESTS])})

    cached = inventory.Index(*[shared.cut(t, "t") for t in (after.files, after.images, after.extra)])
    # Digests are known by content: where only a part was computed before, it is computed again.
    records, again, _ = index.run_index(listing, cached, lambda rows: never(rows.where("status <> 'unchanged'")).where("false"), lambda hashes: hashes.limit(0).join(cached.images, "content_hash"), desired=())
    assert records.where("hash_computed OR image_computed").count() == 0
    assert again.files.exceptAll(cached.files).isEmpty() and cached.files.exceptAll(again.files).isEmpty()


def test_a_hot_content_is_one_class(spark):
    n = 3000
    rows = [(f"/hot/{i}", "h", None, None) for i in range(n)] + [("/one", "x", "r", "b")]
    df = spark.createDataFrame(rows, "path string, h0 string, h1 string, h2 string")
    assert sorted(map(tuple, match.class_sizes(df).collect())) == [(0, "h", n), (0, "x", 1), (1, "r", 1), (2, "b", 1)]
    assert match.find_classes(df, df).count() == n + 3  # not n * n
    assert match.diff_classes(df, df).where("tier = 0").count() == n + 1
    assert [tuple(r) for r in match.duplicate_classes(df.unionByName(df)).collect()] == [(0, "h", n)]


def test_reports_are_in_order(spark):
    for name in ("q_find", "q_diff_matches", "q_diff_classes"):
        paths = [r["path"] for r in queries.QUERIES[name](spark, SF).collect()]
        assert paths == sorted(paths)
    places = [r["pos"] for r in queries.q_lookup(spark, SF).collect()]
    assert places == sorted(places)


def test_display(spark):
    df = spark.createDataFrame([("\\\\?\\C:\\x", 1_500_000_001_999), ("/plain", -1)], "path string, ns long")
    got = df.select(predicates.display_path(F.col("path")).alias("p"), F.date_format(predicates.mtime_to_ts(F.col("ns")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).collect()
    assert [tuple(r) for r in got] == [("C:\\x", "1970-01-01 00:25:00.000001"), ("/plain", "1969-12-31 23:59:59.999999")]
    assert datetime.timedelta(microseconds=1_500_000_001) == datetime.timedelta(minutes=25, microseconds=1)


def test_discard_removes_what_was_cut(spark):
    kept = shared.cut(spark.range(3), "some")
    path = shared._written[-1]
    assert kept.count() == 3 and shared.exists(spark, path)
    shared.discard(spark)
    assert not shared.exists(spark, path)


def test_each_row_is_read_once(spark):
    """Whatever is done with the four tables of a run, contents are digested once and decoded once."""
    read, decoded = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    listing = fx.docs_files(spark, SF).select("doc_id", "path", "inode", "size", "mtime_ns", "error", "h0")
    stored = inventory.Index(fx.files_old(spark, SF), fx.images_tbl(spark, SF), fx.extra_tbl(spark, SF))

    def counted(counter):
        def pass_on(batches):
            for batch in batches:
                counter.add(batch.num_rows)
                yield batch
        return pass_on

    def digest(rows):
        told = rows.mapInArrow(counted(read), rows.schema)
        return told.withColumns({"content": F.col("h0"), "new": F.struct(*[F.col("h0").alias(d) for d in index.DIGESTS])})

    def decode(hashes):
        told = hashes.mapInArrow(counted(decoded), hashes.schema)
        return told.select("content_hash", *[F.lit(1).alias(c) for c in ("width", "height")], *[F.lit("x").alias(c) for c in ("rothash", "blockhash")])

    run = index.run_index(listing, stored, digest, decode)
    for _ in range(2):
        for table in (run.records, run.index.files, run.index.images, run.index.extra, run.failed):
            table.collect()
    records = run.records.collect()
    assert read.value == sum(r["read"] for r in records) > 0
    assert decoded.value == len({r["content_hash"] for r in records if r["image_computed"]}) > 0


def _tree(folder):
    (folder / "a/.hidden/deep").mkdir(parents=True)
    files = {"a/x.txt": b"one", "a/.hidden/y.jpg": b"", "a/.hidden/deep/_z": b"z" * 3_000_000, "a/.picasa.ini": b"no", "b": b"two"}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    (folder / "link").symlink_to(folder / "b")
    (folder / "loop").symlink_to(folder)
    return {str(folder / name): data for name, data in files.items()}


def test_listing_against_a_walk(spark, tmp_path, monkeypatch):
    _tree(tmp_path)
    want = set()
    for folder, _, names in os.walk(tmp_path):
        for name in names:
            path = os.path.join(folder, name)
            if not os.path.islink(path):
                seen = os.stat(path)
                want.add((path, seen.st_ino, seen.st_size, seen.st_mtime_ns, None))
    for enough in (1, 3, 64):
        monkeypatch.setattr(listing, "PARTITIONS", enough)
        df = listing.list_folders(spark, [str(tmp_path)])
        rows = list(map(tuple, df.collect()))
        assert df.schema == inventory.LISTING and set(rows) == want and len(rows) == len(want)
    one = [str(tmp_path / "b"), str(tmp_path / "gone")]
    rows = {r["path"]: r for r in listing.list_folders(spark, one).collect()}
    assert rows[one[0]]["size"] == 3 and rows[one[0]]["error"] is None and "No such file" in rows[one[1]]["error"]
    many = tmp_path / "many"
    many.mkdir()
    for k in range(70):
        (many / f"d{k}").mkdir()
        (many / f"d{k}/f").write_bytes(b"x" * k)
    assert sorted(r["size"] for r in listing.list_folders(spark, [str(many)]).collect()) == list(range(70))


def test_a_run_over_real_files(spark, tmp_path):
    """Listed, read block by block, told where reading failed, and the second run reads nothing."""
    files = _tree(tmp_path)
    nothing = inventory.Index(*[spark.createDataFrame([], s) for s in (inventory.FILES, inventory.IMAGES, inventory.EXTRA)])
    gone = spark.createDataFrame([(str(tmp_path / "gone"), 1, 1, 1, None), ("/bad", None, None, None, "io error")], inventory.LISTING)
    listed = listing.list_folders(spark, [str(tmp_path)]).unionByName(gone)
    decode = lambda hashes: hashes.select("content_hash", *[F.lit(None).cast("int").alias(c) for c in ("width", "height")], *[F.lit(None).cast("string").alias(c) for c in ("rothash", "blockhash")])
    run = index.run_index(listed, nothing, digests.digest_files, decode)
    got = {r["path"]: (r["content_hash"], r["md5"], r["sha1"]) for r in run.records.collect()}
    assert got == {p: (hashlib.sha256(d).hexdigest(), hashlib.md5(d).hexdigest(), hashlib.sha1(d).hexdigest()) for p, d in files.items() if ".picasa" not in p}
    failed = {r["path"]: r["error"] for r in run.failed.collect()}
    assert failed.keys() == {str(tmp_path / "gone"), "/bad"} and "No such file" in failed[str(tmp_path / "gone")]
    assert [r["width"] for r in run.index.images.collect()] == [None]  # y.jpg is recorded as a failed photo
    again = index.run_index(listed, run.index, digests.digest_files, decode)
    assert again.records.where("hash_computed OR image_computed OR read").count() == 0 and again.records.count() == len(got)


def test_a_photo_that_fails_to_decode(spark):
    """A photo of no supported kind is recorded as such; one that fails otherwise fails its files, whose contents are recorded."""
    listing_rows = [(p, k, 5, 5, None) for k, p in enumerate(("/good.jpg", "/odd.jpg", "/broken.jpg", "/copy-of-broken.heic", "/copy-of-broken.txt"))]
    listed = spark.createDataFrame(listing_rows, inventory.LISTING)
    nothing = inventory.Index(*[spark.createDataFrame([], s) for s in (inventory.FILES, inventory.IMAGES, inventory.EXTRA)])
    content = F.when(F.col("path").contains("broken"), "b").when(F.col("path") == "/odd.jpg", "o").otherwise("g")

    def digest(rows):
        return rows.withColumns({"content": content, "new": F.struct(*[content.alias(d) for d in index.DIGESTS])})

    def decode(hashes):
        h = F.col("content_hash")
        size = F.when(h == "g", 7).cast("int")
        return hashes.select(h, size.alias("width"), size.alias("height"), F.when(h == "g", "r").alias("rothash"), F.when(h == "g", "k").alias("blockhash"), F.when(h == "b", "device lost").alias("failure"))

    run = index.run_index(listed, nothing, digest, decode)
    assert {r["path"]: r["width"] for r in run.records.collect()} == {"/good.jpg": 7, "/odd.jpg": None, "/copy-of-broken.txt": None}
    assert {tuple(r) for r in run.failed.collect()} == {("/broken.jpg", "device lost"), ("/copy-of-broken.heic", "device lost")}
    assert {r["content_hash"]: r["width"] for r in run.index.images.collect()} == {"g": 7, "o": None} and run.index.files.count() == 5
    again = index.run_index(listed, run.index, digest, decode)
    assert again.failed.count() == 2 and again.records.where("hash_computed").count() == 0


def test_unstable_reads_are_tried_again(spark):
    """As contents that change while they are read: /a holds still at once, /b at the third read, /c never, /d cannot be read."""
    todo = spark.createDataFrame([(p, 1, 1, 1) for p in ("/a", "/b", "/c", "/d")], "path string, inode long, size long, mtime_ns long")
    tries = []

    def digest(rows):
        tries.append(1)
        n = len(tries)
        info = lambda size: F.struct(F.lit(1).cast("long").alias("inode"), size.cast("long").alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
        still = (F.col("path") == "/a") | ((F.col("path") == "/b") & F.lit(n == 3))
        return rows.withColumns({
            "content": F.concat("path", F.lit(str(n))), "new": F.struct(*[F.lit("x").alias(d) for d in index.DIGESTS]), "before": info(F.lit(1)), "after": info(F.when(still, 1).otherwise(2)),
            "failure": F.when(F.col("path") == "/d", "denied"),
        })

    good, bad = index.read_contents(todo, digest)
    assert sorted((r["path"], r["content"]) for r in good.collect()) == [("/a", "/a1"), ("/b", "/b3")]
    assert {r["path"]: r["error"] for r in bad.collect()} == {"/c": "changed while it was read, 3 times", "/d": "denied"} and len(tries) == 3


def test_blocks_of_a_content(spark):
    data = {"a": b"hello world", "b": b"", "c": "é日本".encode() * 999, "d": b"xy"}
    rows = [(p, k, d[7 * k : 7 * k + 7]) for p, d in data.items() for k in range(max(1, -(-len(d) // 7)))]
    rows += [("a", 1, b"orld"), ("gap", 0, b"1"), ("gap", 2, b"3"), ("late", 1, b"1"), ("other", 0, b"1"), ("other", 0, b"2"), ("null", None, b"1"), ("empty", 0, None)]
    df = spark.createDataFrame(rows, "path string, block long, data binary").repartition(7)
    got = {r["path"]: r for r in digests.digest_blocks(df, ["path"]).collect()}
    for p, d in data.items():
        assert (got[p]["md5"], got[p]["sha1"], got[p]["sha256"], got[p]["n_bytes"], got[p]["failure"]) == (*(hashlib.new(h, d).hexdigest() for h in ("md5", "sha1", "sha256")), len(d), None)
    assert {p: got[p]["failure"] for p in ("gap", "late", "other", "null", "empty")} == {
        "gap": "block 1 is missing", "late": "block 0 is missing", "other": "block 0 is there twice", "null": "a block or its number is null", "empty": "a block or its number is null"}
    assert all(got[p]["md5"] is None for p in ("gap", "late", "other")) and digests.digest_blocks(df.where("false"), ["path"]).count() == 0


def test_index_in_buckets_is_not_shuffled(spark, tmp_path):
    stored = inventory.Index(fx.files_old(spark, SF), fx.images_tbl(spark, SF), fx.extra_tbl(spark, SF))
    version = inventory.write_index(stored, str(tmp_path), 8)
    laid = inventory.read_index(spark, version)
    for name in ("files", "images", "extra"):
        assert sorted(getattr(laid, name).collect(), key=str) == sorted(getattr(stored, name).select(*inventory.SCHEMAS[name].names).collect(), key=str)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = shared.cut(fx.docs_files(spark, SF).withColumn("content_hash", F.col("h0")), "docs")
        for df, plain in (
            (index.classify(docs, laid.files), index.classify(docs, stored.files)),
            (index.attach_images(docs, laid.images), index.attach_images(docs, stored.images)),
            (index.images_to_compute(docs, laid.images), index.images_to_compute(docs, stored.images)),
        ):
            assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))
            lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
            at = next(k for k, line in enumerate(lines) if "Bucketed: true" in line)
            depth, above = len(re.match(r"\W*", lines[at])[0]), []
            for line in reversed(lines[:at]):
                if (d := len(re.match(r"\W*", line)[0])) < depth:
                    depth = d
                    above.append(line)
            assert any("Join" in x for x in above)
            assert not any("Exchange" in x for x in above[: next(k for k, x in enumerate(above) if "Join" in x)]), "\n".join(lines)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # What is read back in buckets can be written again, as the next version.
    upserted = inventory.upsert(laid.files, laid.files.limit(1).withColumn("seq", F.lit(1)), ["path"], "seq")
    again = inventory.read_index(spark, inventory.write_index(inventory.Index(upserted, laid.images, laid.extra), str(tmp_path), 8))
    assert again.files.count() == laid.files.count()
