"""Every query against its DuckDB SQL, and relations that hold between queries."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfold import queries
from tallyfold.operators import audit, match
from tallyfold.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "events", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def cell(x):
        return f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    place = [d[0] for d in cursor.description]
    assert sorted(place) == names
    order = [place.index(n) for n in names]
    assert plain(df.select(*names).collect()) == plain([tuple(r[k] for k in order) for r in cursor.fetchall()])


def test_tiers_and_missing_part_the_source(spark):
    d = fx.docs_files(spark, SF)
    src, dest = d.where("is_src"), d.where("NOT is_src")
    diff = {r["path"]: r for r in match.diff(src, dest).collect()}
    missing = {r["path"] for r in match.missing(src, dest).collect()}
    assert missing == {p for p, r in diff.items() if r["tier"] is None}
    found = {r["path"]: set(r["matches"]) for r in match.find_matches(src, dest).collect()}
    assert all(set(r["matches"] or []) <= found[p] for p, r in diff.items())


def test_self_match_and_null_hash(spark):
    df = spark.createDataFrame([("a", "x", None, None), ("b", None, None, None)], "path string, h0 string, h1 string, h2 string")
    assert {r["path"]: r["matches"] for r in match.find_matches(df, df).collect()} == {"a": ["a"], "b": []}


def test_text_copy_of_a_photo_fails_to_decode(spark):
    files = spark.createDataFrame([("/a.txt", "h")], "path string, content_hash string")
    images = spark.createDataFrame([("h", 1, 1, "r", "b")], "content_hash string, width int, height int, rothash string, blockhash string")
    observed = spark.createDataFrame([("/a.txt", "h", False, None, None, None, None)], "path string, content_hash string, decode_ok boolean, width int, height int, rothash string, blockhash string")
    assert [r["reason"] for r in audit.validate(observed, files, images).collect()] == [audit.FAILED_DECODE]
    with pytest.raises(RuntimeError):
        audit.require_clean(audit.validate(observed, files, images))
    audit.require_clean(audit.validate(observed.where("false"), files, images))


def test_inventory_lists_the_folder(spark):
    from tallyfold.sources.inventory import read_inventory

    assert read_inventory(spark, [SF]).where(F.col("path").endswith("documents.parquet") & F.col("size").isNotNull()).count() == 1
