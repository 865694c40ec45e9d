"""Queries over the fixture views and the SQL they are compared with."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests, grids, predicates
from .functions.digests import hash_report, plan_digests, stable, with_digests
from .operators import audit, index, match
from .operators.prefix import hash_neighbours, min_unique_by_halving, min_unique_prefix
from .operators.seen import first_seen, merge_filters, seen_filter
from .plans import commands
from .plans import fixtures as fx
from .schema import FILES
from .sources import inventory as src
from .sources.shared import cut, shared_dir
from .streaming import index_stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_VIEWS = {
    "docs_files": """SELECT doc_id, CAST(substr(source, 4) AS INT) < 5 AS is_src,
  '/lib/' || source || '/' || lang || '/' || doc_id || '/' ||
  CASE WHEN doc_id % 41 = 0 THEN '.picasa.ini' WHEN doc_id % 37 = 0 THEN '._IMG_' || doc_id || '.jpg'
       ELSE 'IMG_' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.heic'
         WHEN 3 THEN '.txt' WHEN 4 THEN '.HEIF' WHEN 5 THEN '.jfif' WHEN 6 THEN '' ELSE '.png' END END AS path,
  doc_id AS inode,
  CAST(CASE doc_id % 29 WHEN 0 THEN 40000000 WHEN 8 THEN 40000001 ELSE strlen(text) END AS BIGINT) AS size,
  (doc_id - 100) * 1000000007 AS mtime_ns,
  CASE WHEN doc_id % 53 = 0 THEN 'io error' END AS error,
  sha256(text) AS h0, CASE WHEN doc_id % 8 <> 2 THEN sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) END AS h1,
  CASE WHEN doc_id % 8 <> 3 THEN sha256(translate(text, '0123456789 ,.', '')) END AS h2 FROM documents""",
    "files_old": """SELECT path, inode + (doc_id % 10 = 3)::INT AS inode, size + (doc_id % 10 = 2)::INT AS size,
  mtime_ns + (doc_id % 10 = 1)::INT AS mtime_ns, h0 AS content_hash FROM docs_files WHERE doc_id % 10 <> 0
UNION ALL SELECT '/gone/' || doc_id, inode, size, mtime_ns, h0 FROM docs_files WHERE doc_id % 50 = 9""",
    "first_of_hash": "SELECT h0, min(doc_id) AS k FROM docs_files GROUP BY h0",
    "images_tbl": """SELECT h0 AS content_hash, CASE WHEN k % 6 <> 1 THEN CAST(100 + k % 50 AS INT) END AS width,
  CASE WHEN k % 6 <> 1 THEN CAST(80 + k % 40 AS INT) END AS height,
  CASE WHEN k % 6 <> 1 AND k % 7 <> 0 THEN sha256('r' || h0) END AS rothash,
  CASE WHEN k % 6 <> 1 THEN sha256('b' || h0) END AS blockhash FROM first_of_hash WHERE k % 6 <> 0""",
    "extra_tbl": """SELECT h0 AS content_hash, sha256('m' || h0) AS md5, CASE WHEN k % 4 <> 1 THEN sha256('s' || h0) END AS sha1,
  CASE WHEN k % 4 <> 1 THEN sha256('t' || h0) END AS sha256 FROM first_of_hash WHERE k % 4 <> 0""",
    "observed": """SELECT f.path, CASE WHEN doc_id % 12 = 1 THEN sha256('x' || h0) ELSE h0 END AS content_hash,
  doc_id % 12 <> 2 AS decode_ok, width + (doc_id % 12 = 3)::INT AS width, height,
  CASE WHEN doc_id % 12 = 4 THEN sha256('y' || h0) ELSE rothash END AS rothash,
  CASE WHEN doc_id % 12 = 5 THEN sha256('z' || h0) ELSE blockhash END AS blockhash
  FROM docs_files f LEFT JOIN images_tbl i ON i.content_hash = f.h0""",
    "named": """SELECT *, CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]+$')), '^.+[.](jpg|jpeg|jpe|jif|jfif|jfi)$') THEN 'jpeg'
  WHEN regexp_matches(lower(regexp_extract(path, '[^/]+$')), '^.+[.](heif|heic)$') THEN 'heic' END AS format FROM docs_files""",
    "photos": "SELECT * FROM named WHERE format IS NOT NULL AND size <= 40000000 AND NOT starts_with(regexp_extract(path, '[^/]+$'), '._')",
    "classified": """SELECT d.*, CASE WHEN o.content_hash IS NULL THEN 'new' WHEN d.inode = o.inode AND d.size = o.size AND d.mtime_ns = o.mtime_ns
  THEN 'unchanged' ELSE 'changed' END AS status FROM docs_files d LEFT JOIN files_old o ON o.path = d.path""",
    "flagged": """SELECT c.*, status <> 'unchanged' AS hash_computed,
  (c.path IN (SELECT path FROM photos) AND h0 NOT IN (SELECT content_hash FROM images_tbl)) AS image_computed FROM classified c""",
    "melted": """SELECT path, is_src, 0 AS kind, h0 AS hash FROM docs_files UNION ALL SELECT path, is_src, 1, h1 FROM docs_files WHERE h1 IS NOT NULL
UNION ALL SELECT path, is_src, 2, h2 FROM docs_files WHERE h2 IS NOT NULL""",
    "pairs": "SELECT DISTINCT s.path, s.kind, d.path AS other FROM melted s JOIN melted d ON s.kind = d.kind AND s.hash = d.hash AND s.is_src AND NOT d.is_src",
    "tiers": "SELECT d.path, CAST(min(kind) AS INT) AS tier FROM docs_files d LEFT JOIN pairs p ON p.path = d.path WHERE is_src GROUP BY d.path",
    "grids_src": """SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 1.0) * 127.5))) AS INT)) AS v
  FROM embeddings""",
    "grids_dst": """SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN v WHEN 1 THEN {rot90}
  ELSE list_transform(v, lambda x, i: CASE WHEN i = 1 THEN (CASE WHEN x > list_aggregate(v[1:16], 'median') THEN x + 1 ELSE x - 1 END) ELSE x END) END AS v
  FROM grids_src WHERE vec_id % 4 < 3""".replace("{rot90}", "list_transform(range(0, 64), lambda i: v[CAST((7 - i % 8) * 8 + i // 8 + 1 AS INT)])"),
    "grids_src_keys": "KEYS(grids_src)",
    "grids_dst_keys": "KEYS(grids_dst)",
    "grid_tiers": """SELECT s.vec_id, d.vec_id AS other, CASE WHEN s.h0 = d.h0 THEN 0 WHEN s.h1 = d.h1 THEN 1 ELSE 2 END AS kind
  FROM grids_src_keys s JOIN grids_dst_keys d ON s.h0 = d.h0 OR s.h1 = d.h1 OR s.h2 = d.h2""",
    "listing_a": "SELECT * FROM docs_files WHERE doc_id % 11 <> 0",
    "listing_b": "SELECT * REPLACE (size + (doc_id % 17 = 0)::INT AS size) FROM docs_files WHERE doc_id % 13 <> 0",
    "listing_c": "SELECT * REPLACE (mtime_ns + (doc_id % 23 = 0)::INT AS mtime_ns) FROM docs_files WHERE doc_id % 19 <> 0",
    "every_listing": """SELECT 'a' AS listing, path, inode, size, mtime_ns FROM listing_a UNION ALL SELECT 'b', path, inode, size, mtime_ns FROM listing_b
UNION ALL SELECT 'c', path, inode, size, mtime_ns FROM listing_c""",
    "event_rows": "SELECT user_id || '/' || event_type AS path, event_id AS seq, epoch_us(ts) * 1000 AS mtime_ns, value FROM events",
    "orient_fields": """SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, event_type = 'click' AS orientation,
  CASE WHEN k % 5 <> 0 THEN k % 10 END AS value FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events)""",
}
_VIEWS["sound_files"] = "SELECT * FROM docs_files WHERE error IS NULL"
_VIEWS["sound_melted"] = _VIEWS["melted"].replace("docs_files", "sound_files")
_VIEWS["sound_pairs"] = _VIEWS["pairs"].replace("melted", "sound_melted")
_VIEWS["sound_tiers"] = _VIEWS["tiers"].replace("docs_files", "sound_files").replace("pairs", "sound_pairs")
_TURN = {  # orientation number: source cell of cell (i // 8, i % 8) in an 8 by 8 grid
    1: "i + 1", 2: "(i // 8) * 8 + 7 - i % 8 + 1", 3: "63 - i + 1", 4: "(7 - i // 8) * 8 + i % 8 + 1", 5: "(i % 8) * 8 + i // 8 + 1",
    6: "(7 - i % 8) * 8 + i // 8 + 1", 7: "(7 - i % 8) * 8 + 7 - i // 8 + 1", 8: "(i % 8) * 8 + 7 - i // 8 + 1",
}


def _turned(v: str, n: int) -> str:
    return f"list_transform(range(0, 64), lambda i: {v}[CAST({_TURN[n]} AS INT)])"


def _dig(v: str) -> str:
    return f"sha256(list_aggregate(list_transform({v}, lambda x: format('{{:02x}}', x)), 'string_agg', ''))"


_ROTHASH = "list_min([" + ", ".join(_dig(_turned("v", n)) for n in (1, 6, 3, 8)) + "])"
_MEDIAN = "list_aggregate(v[CAST(i // 16 * 16 + 1 AS INT) : CAST(i // 16 * 16 + 16 AS INT)], 'median')"
_BITS = f"""list_aggregate(list_transform(range(0, 64), lambda i: CASE WHEN v[CAST(i + 1 AS INT)] > {_MEDIAN}
  OR (abs(v[CAST(i + 1 AS INT)] - {_MEDIAN}) < 1 AND {_MEDIAN} > 127.5) THEN '1' ELSE '0' END), 'string_agg', '')"""
for _t in ("grids_src", "grids_dst"):
    _VIEWS[f"{_t}_keys"] = f"SELECT vec_id, {_dig('v')} AS h0, {_ROTHASH} AS h1, {_BITS} AS h2 FROM {_t}"


def _with(body: str) -> str:
    """The statement with the views that it needs in front."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    head = "WITH " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in needed)
    own = body.removeprefix("WITH ")  # a statement with views of its own goes on with them
    return body if not needed else f"{head}\n{body}" if own == body else f"{head},\n{own}"


def query(sql: str | None):
    """Register a query under its function's name, with the DuckDB SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _with(sql)
        return f

    return register


def _joined(column: str):
    return F.array_join(column, "|")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = fx.docs_files(spark, sf)
    return d.where("is_src"), d.where("NOT is_src")


def _grid_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    def keys(g: DataFrame) -> DataFrame:
        return g.select(
            F.col("vec_id").cast("string").alias("path"), grids.grid_digest(F.col("values")).alias("h0"), grids.rothash().alias("h1"), grids.cell_bits(brightest=255).alias("h2")
        )

    return keys(fx.grids_src(spark, sf)), keys(fx.grids_dst(spark, sf))


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    """Listing with status; the content hash is filled in for new and changed files, as after digesting."""
    d = fx.docs_files(spark, sf)
    return index.classify(d, fx.files_old(spark, sf)).withColumn("content_hash", F.coalesce("content_hash", "h0"))


# --- sources and sinks ---------------------------------------------------------------------------

@query("SELECT path, inode, size, mtime_ns, error FROM docs_files")
def q_inventory(spark, sf):
    return src.as_listing(fx.docs_files(spark, sf))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents""")
def q_digest_blocks(spark, sf):
    """Contents that come in blocks of 1000 bytes are digested block by block."""
    raw = F.col("raw")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / 1000))
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("raw"))
    blocks = docs.select("path", "raw", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return digests.digest_blocks(blocks.select("path", "block", F.substring(raw, (F.col("block") * 1000 + 1).cast("int"), F.lit(1000)).alias("data")), ["path"]).drop("failure")


@query("""SELECT path, max(seq) AS seq, arg_max(value, seq) AS value FROM event_rows GROUP BY path""")
def q_upsert_latest(spark, sf):
    return src.latest_rows(fx.event_rows(spark, sf), ["path"], "seq").select("path", "seq", "value")


@query("""SELECT path, inode, size, mtime_ns, content_hash FROM files_old WHERE path NOT IN (SELECT path FROM classified WHERE status = 'changed')
UNION ALL SELECT path, inode, size, mtime_ns, h0 FROM classified WHERE status = 'changed'""")
def q_upsert_replace(spark, sf):
    changed = _classified(spark, sf).where("status = 'changed'").select("path", "inode", "size", "mtime_ns", "content_hash", F.lit(1).alias("seq"))
    return src.upsert(fx.files_old(spark, sf), changed, ["path"], "seq")


@query("""SELECT path, '{"path":"' || path || '","size":' || size || ',"hash":"' || h0 || '"' || coalesce(',"md5":"' || md5 || '"', '')
  || coalesce(',"sha1":"' || sha1 || '"', '') || coalesce(',"sha256":"' || e.sha256 || '"', '') || '}' AS json
FROM docs_files LEFT JOIN extra_tbl e ON e.content_hash = h0""")
def q_json_record(spark, sf):
    d = fx.docs_files(spark, sf).withColumn("content_hash", F.col("h0")).join(fx.extra_tbl(spark, sf), "content_hash", "left")
    return src.to_json_records(d)


@query("""SELECT left(h0, 12) || ' ' || lpad(CAST(size // 1024 AS VARCHAR), 8, ' ') || 'K ' || path AS line FROM flagged WHERE hash_computed OR image_computed""")
def q_text_line(spark, sf):
    return src.to_text_lines(predicates.changed_only(index.computed_flags(_classified(spark, sf), fx.images_tbl(spark, sf))))


_MANIFEST = """SELECT path AS src_path, {rel} AS rel_path, {out} AS out_path, action, {error} AS error FROM tiers, (SELECT 'copy' AS action, '/out/copy' AS root
UNION ALL SELECT 'link', '/out/link') WHERE tier IS NULL"""


def _manifest(spark, sf, root="/lib"):
    return src.transfer_manifest(match.missing(*_sides(spark, sf)), root, {"copy": "/out/copy", "link": "/out/link"})


@query(_MANIFEST.format(rel="substr(path, 6)", out="root || '/' || substr(path, 6)", error="CAST(NULL AS VARCHAR)"))
def q_manifest(spark, sf):
    return _manifest(spark, sf)


@query(_MANIFEST.format(
    rel="CASE WHEN starts_with(path, '/lib/src1/') THEN substr(path, 11) END",
    out="CASE WHEN starts_with(path, '/lib/src1/') THEN root || '/' || substr(path, 11) END",
    error="CASE WHEN NOT starts_with(path, '/lib/src1/') THEN 'not relative to source' END"))
def q_manifest_component(spark, sf):
    return _manifest(spark, sf, "/lib/src1")


@query("SELECT DISTINCT root || '/' || substr(path, 6) AS out_path FROM tiers, (SELECT '/out/copy' AS root UNION ALL SELECT '/out/link') WHERE tier IS NULL AND path IN (SELECT path FROM docs_files WHERE doc_id % 3 = 0)")
def q_collisions(spark, sf):
    d = fx.docs_files(spark, sf).where("doc_id % 3 = 0")
    existing = d.select(F.explode(F.array(*[F.concat(F.lit(r), predicates.relative_to(F.col("path"), "/lib")) for r in ("/out/copy/", "/out/link/")])).alias("out_path"))
    return src.collisions(_manifest(spark, sf), existing)


# --- predicates and functions --------------------------------------------------------------------

@query("SELECT path FROM docs_files WHERE regexp_extract(path, '[^/]+$') <> '.picasa.ini' AND NOT starts_with(regexp_extract(path, '[^/]+$'), '._')")
def q_ignore(spark, sf):
    return predicates.ignore_names(fx.docs_files(spark, sf)).select("path")


@query("SELECT path, error IS NULL AS ok FROM docs_files")
def q_split_errors(spark, sf):
    ok, failed = predicates.split_errors(fx.docs_files(spark, sf))
    return ok.select("path", F.lit(True).alias("ok")).unionByName(failed.select("path", F.lit(False).alias("ok")))


@query("SELECT path FROM photos")
def q_photo_candidates(spark, sf):
    return index.candidates(fx.docs_files(spark, sf)).select("path")


@query("SELECT path, format FROM named")
def q_photo_format(spark, sf):
    return fx.docs_files(spark, sf).select("path", predicates.photo_format(F.col("path")).alias("format"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def q_digests(spark, sf):
    return with_digests(fx.table(spark, sf, "documents").select("doc_id", "text"), "text", key=None).drop("text")


@query("""SELECT path, array_to_string(list_filter([CASE WHEN md5 IS NULL THEN 'md5' END, CASE WHEN sha1 IS NULL THEN 'sha1' END,
  CASE WHEN e.sha256 IS NULL THEN 'sha256' END], lambda x: x IS NOT NULL), '|') AS todo,
  md5 IS NULL AND sha1 IS NULL AND e.sha256 IS NULL AS store_extra FROM docs_files LEFT JOIN extra_tbl e ON e.content_hash = h0""")
def q_digest_plan(spark, sf):
    d = fx.docs_files(spark, sf).withColumn("content_hash", F.col("h0")).join(fx.extra_tbl(spark, sf), "content_hash", "left")
    return plan_digests(d).select("path", _joined("todo").alias("todo"), "store_extra")


@query("""SELECT path, CASE WHEN md5 IS NULL THEN md5(path) ELSE md5 END AS md5, CASE WHEN sha1 IS NULL THEN sha1(path) ELSE sha1 END AS sha1, e.sha256
FROM docs_files LEFT JOIN extra_tbl e ON e.content_hash = h0""")
def q_digest_merge(spark, sf):
    d = fx.docs_files(spark, sf).withColumn("content_hash", F.col("h0")).join(fx.extra_tbl(spark, sf), "content_hash", "left")
    new = F.struct(F.md5("path").alias("md5"), F.sha1("path").alias("sha1"), F.sha2("path", 256).alias("sha256"))
    return digests.merge_digests(plan_digests(d, ("md5", "sha1")).withColumn("new", new)).select("path", "md5", "sha1", "sha256")


@query("SELECT path FROM flagged WHERE hash_computed OR image_computed")
def q_changed_only(spark, sf):
    return predicates.changed_only(index.computed_flags(_classified(spark, sf), fx.images_tbl(spark, sf))).select("path")


@query("""SELECT path, coalesce(error, h0, 'missing') AS hash0, coalesce(error, rothash, 'missing') AS hash1, coalesce(error, blockhash, 'missing') AS hash2
FROM docs_files LEFT JOIN images_tbl i ON i.content_hash = h0""")
def q_hash_report(spark, sf):
    d = fx.docs_files(spark, sf).withColumn("content_hash", F.col("h0")).join(fx.images_tbl(spark, sf), "content_hash", "left")
    return hash_report(d, {"hash0": "h0", "hash1": "rothash", "hash2": "blockhash"})


@query("""SELECT CAST(v AS VARCHAR) AS value, v >= 0 AND v <= 9223372036854775807 AS ok FROM (SELECT CAST(doc_id - 50 AS DECIMAL(20,0)) AS v FROM documents
UNION ALL SELECT CAST(9223372036854775808 AS DECIMAL(20,0)) FROM documents WHERE doc_id = 0)""")
def q_u63(spark, sf):
    d = fx.table(spark, sf, "documents")
    small = d.select((F.col("doc_id") - 50).cast("decimal(20,0)").alias("v"))
    large = d.where("doc_id = 0").select(F.lit("9223372036854775808").cast("decimal(20,0)").alias("v"))
    return predicates.check_u63(small.unionByName(large), ["v"]).select(F.col("v").cast("string").alias("value"), F.col("range_error").isNull().alias("ok"))


@query("""SELECT path, (mtime_ns - ((mtime_ns % 1000) + 1000) % 1000) // 1000 AS mtime_us,
  mtime_ns - ((mtime_ns % 100) + 100) % 100 AS from_filetime FROM docs_files""")
def q_time_codec(spark, sf):
    hundred = (F.col("mtime_ns") - F.pmod(F.col("mtime_ns"), F.lit(100).cast("long"))).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    filetime = hundred.cast("long") + predicates.FILETIME_EPOCH
    return fx.docs_files(spark, sf).select("path", predicates.mtime_micros(F.col("mtime_ns")).alias("mtime_us"), predicates.filetime_to_ns(filetime).alias("from_filetime"))


@query("""SELECT path, CASE arg_max(value, seq) FILTER (WHERE orientation AND value IS NOT NULL) WHEN 2 THEN 'hflip' WHEN 3 THEN 'rot180' WHEN 4 THEN 'vflip'
  WHEN 5 THEN 'transpose' WHEN 6 THEN 'rot90' WHEN 7 THEN 'transverse' WHEN 8 THEN 'rot270' ELSE 'none' END AS transform FROM orient_fields GROUP BY path""")
def q_orientation(spark, sf):
    return grids.orientation_transform(fx.orient_fields(spark, sf))


@query("""SELECT p.path, CASE WHEN doc_id % 2 = 0 THEN 'recorded as failed photo but looks valid now' ELSE 'bad marker' END AS verdict
FROM photos p JOIN images_tbl i ON i.content_hash = p.h0 WHERE width IS NULL OR height IS NULL""")
def q_broken(spark, sf):
    d = fx.docs_files(spark, sf).withColumn("content_hash", F.col("h0"))
    ok = F.col("doc_id") % 2 == 0
    redecoded = d.select("path", ok.alias("ok"), F.when(~ok, "bad marker").alias("cause"))
    return audit.broken(d.select("path", "size", "content_hash"), fx.images_tbl(spark, sf), redecoded)


@query("SELECT event_id, unnest(json_keys(props)) AS tag, props->>'$.k' AS value FROM events")
def q_fields_long(spark, sf):
    return predicates.explode_fields(fx.table(spark, sf, "events"), "props", ["event_id"])


@query("""SELECT event_id, 'k' AS tag, ifd, CASE ifd WHEN 'primary' THEN props->>'$.k' ELSE event_type END AS value FROM events, (SELECT unnest(['primary', 'thumbnail']) AS ifd)""")
def q_fields_directories(spark, sf):
    both = F.concat(F.lit('{"primary":'), "props", F.lit(',"thumbnail":{"k":"'), "event_type", F.lit('"}}'))
    return predicates.explode_directories(fx.table(spark, sf, "events").withColumn("both", both), "both", ["event_id"])


# --- pictures ------------------------------------------------------------------------------------

@query(f"SELECT vec_id, {_ROTHASH} AS rothash FROM grids_src")
def q_rothash(spark, sf):
    return fx.grids_src(spark, sf).select("vec_id", grids.rothash().alias("rothash"))


def _picture_dig(turn: str) -> str:
    return _dig(f"list_transform(range(0, 480), lambda i: v[CAST({turn} AS INT)])")


_PICTURES = """(SELECT vec_id, list_transform(range(0, 480), lambda i: v[CAST((i * 7 + i // 24 * 3) % 64 + 1 AS INT)]) AS v FROM grids_src)"""
_PICTURE_TURNS = ("i + 1", "(19 - i % 20) * 24 + i // 20 + 1", "480 - i", "(i % 20) * 24 + 23 - i // 20 + 1")


@query(f"SELECT vec_id, list_min([{', '.join(map(_picture_dig, _PICTURE_TURNS))}]) AS rothash FROM {_PICTURES}")
def q_rothash_pictures(spark, sf):
    return fx.pictures(spark, sf).select("vec_id", grids.picture_rothash()("values", "width", "height").alias("rothash"))


@query(f"SELECT vec_id, {_BITS} AS bits FROM grids_src")
def q_blockhash(spark, sf):
    return fx.grids_src(spark, sf).select("vec_id", grids.cell_bits(brightest=255).alias("bits"))


@query("""WITH cells AS (SELECT vec_id, x, y, v[CAST(((y * 24 + x) * 7 + y * 3) % 64 + 1 AS INT)] AS c FROM grids_src, (SELECT unnest(range(24)) AS x), (SELECT unnest(range(20)) AS y)),
shares AS (SELECT b, w, x, greatest(0, least((b + 1) * w / 16.0, x + 1) - greatest(b * w / 16.0, x)) AS s
  FROM (SELECT unnest(range(16)) AS b), (SELECT unnest([20, 24]) AS w), (SELECT unnest(range(24)) AS x)),
blocks AS (SELECT vec_id, r.b AS i, q.b AS j, sum(c * r.s * q.s) AS m FROM cells JOIN shares r ON r.w = 20 AND r.x = y AND r.s > 0 JOIN shares q ON q.w = 24 AND q.x = cells.x AND q.s > 0 GROUP BY ALL),
bands AS (SELECT vec_id, i // 4 AS band, median(m) AS mid FROM blocks GROUP BY ALL)
SELECT b.vec_id, string_agg(CASE WHEN m > mid OR (abs(m - mid) < 1 AND mid > 255 * 1.5 * 1.25 / 2) THEN '1' ELSE '0' END, '' ORDER BY i * 16 + j) AS bits
FROM blocks b JOIN bands d ON d.vec_id = b.vec_id AND d.band = i // 4 GROUP BY b.vec_id""")
def q_blockhash_pictures(spark, sf):
    return fx.pictures(spark, sf).select("vec_id", grids.blockhash(16, 255)("values", "width", "height").alias("bits"))


@query("SELECT vec_id, CASE vec_id % 8 + 1 " + " ".join(f"WHEN {n} THEN {_dig(_turned('v', n))}" for n in _TURN) + " END AS digest FROM grids_src")
def q_apply_orientation(spark, sf):
    names = F.array(*map(F.lit, grids.TRANSFORMS.values()))
    g = fx.grids_src(spark, sf).withColumn("transform", F.element_at(names, (F.col("vec_id") % 8 + 1).cast("int")))
    return grids.apply_orientation(g).select("vec_id", grids.grid_digest(F.col("values")).alias("digest"))


@query("""SELECT h0 AS content_hash, CASE WHEN ok THEN CAST(100 + k % 50 AS INT) END AS width, CASE WHEN ok THEN CAST(80 + k % 40 AS INT) END AS height,
  CASE WHEN ok AND format = 'jpeg' THEN sha256('r' || h0) END AS rothash, CASE WHEN ok THEN sha256('b' || h0) END AS blockhash
FROM (SELECT f.h0, k, k % 6 <> 1 AS ok, n.format FROM first_of_hash f JOIN named n ON n.doc_id = f.k) WHERE format IS NOT NULL""")
def q_image_records(spark, sf):
    k = F.col("doc_id")
    first = fx.docs_files(spark, sf).groupBy("h0").agg(F.min("doc_id").alias("doc_id"), F.min_by("path", "doc_id").alias("path"))
    return grids.image_records(first.select(
        F.col("h0").alias("content_hash"), predicates.photo_format(F.col("path")).alias("format"), (k % 6 != 1).alias("decode_ok"),
        (100 + k % 50).cast("int").alias("width"), (80 + k % 40).cast("int").alias("height"), fx.tagged("r").alias("rothash"), fx.tagged("b").alias("blockhash")))


# --- index ---------------------------------------------------------------------------------------

@query("""SELECT pos, r.path, content_hash FROM (SELECT doc_id AS pos, path FROM docs_files WHERE doc_id % 7 = 0 UNION ALL SELECT -1, path FROM docs_files WHERE doc_id = 7
UNION ALL SELECT -2, '/nope' FROM docs_files WHERE doc_id = 0) r LEFT JOIN files_old o ON o.path = r.path""")
def q_lookup(spark, sf):
    d = fx.docs_files(spark, sf)
    requests = (
        d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("pos"), "path")
        .unionByName(d.where("doc_id = 7").select(F.lit(-1).cast("long").alias("pos"), "path"))
        .unionByName(d.where("doc_id = 0").select(F.lit(-2).cast("long").alias("pos"), F.lit("/nope").alias("path")))
    )
    return index.lookup_paths(requests, fx.files_old(spark, sf)).select("pos", "path", "content_hash")


@query("SELECT path, status FROM classified")
def q_change_detect(spark, sf):
    return index.classify(fx.docs_files(spark, sf), fx.files_old(spark, sf)).select("path", "status")


@query("SELECT path, status FROM classified")
def q_change_detect_bucketed(spark, sf):
    """The same against an index laid out in buckets, which is not shuffled."""
    stored = src.Index(fx.files_old(spark, sf), fx.images_tbl(spark, sf), fx.extra_tbl(spark, sf))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = src.write_index(stored, f"{shared_dir(spark)}/index", buckets)
    return index.classify(fx.docs_files(spark, sf), src.read_index(spark, version).files).select("path", "status")


@query("SELECT DISTINCT h0 AS content_hash FROM photos WHERE h0 NOT IN (SELECT content_hash FROM images_tbl)")
def q_images_todo(spark, sf):
    return index.images_to_compute(fx.docs_files(spark, sf).withColumn("content_hash", F.col("h0")), fx.images_tbl(spark, sf))


@query("""SELECT d.path, CASE WHEN d.path IN (SELECT path FROM photos) THEN width END AS width, CASE WHEN d.path IN (SELECT path FROM photos) THEN height END AS height
FROM docs_files d LEFT JOIN images_tbl i ON i.content_hash = h0""")
def q_attach_images(spark, sf):
    d = fx.docs_files(spark, sf).select("path", "size", F.col("h0").alias("content_hash"))
    return index.attach_images(d, fx.images_tbl(spark, sf)).select("path", "width", "height")


@query("""SELECT path, CASE WHEN ok THEN md5 END AS md5, CASE WHEN ok THEN sha1 END AS sha1, CASE WHEN ok THEN sha256 END AS sha256 FROM (
SELECT path, md5, sha1, e.sha256, status = 'unchanged' AND md5 IS NOT NULL AND sha1 IS NOT NULL AND e.sha256 IS NOT NULL AS ok
FROM classified LEFT JOIN extra_tbl e ON e.content_hash = h0)""")
def q_attach_extra(spark, sf):
    return index.attach_extra(_classified(spark, sf), fx.extra_tbl(spark, sf)).select("path", "md5", "sha1", "sha256")


@query("""SELECT CAST(count(*) AS BIGINT) AS files, count(DISTINCT h0) AS contents, CAST(count(*) FILTER (WHERE hash_computed) AS BIGINT) AS computed,
  CAST(count(*) FILTER (WHERE NOT hash_computed) AS BIGINT) AS reused FROM flagged""")
def q_index_summary(spark, sf):
    return index.index_summary(index.computed_flags(_classified(spark, sf), fx.images_tbl(spark, sf)))


_RUN = """WITH listed AS (SELECT c.*, o.content_hash AS old FROM classified c LEFT JOIN files_old o ON o.path = c.path
  WHERE error IS NULL AND regexp_extract(c.path, '[^/]+$') <> '.picasa.ini' AND NOT starts_with(regexp_extract(c.path, '[^/]+$'), '._')),
hashed AS (SELECT *, CASE WHEN status = 'unchanged' THEN old ELSE h0 END AS content_hash FROM listed),
more AS (SELECT h.*, e.md5, e.sha1, e.sha256, coalesce(status = 'unchanged' AND md5 IS NOT NULL AND sha1 IS NOT NULL AND e.sha256 IS NOT NULL, false) AS whole
  FROM hashed h LEFT JOIN extra_tbl e ON e.content_hash = h.content_hash)
"""


def _index_run(spark, sf):
    content = fx.table(spark, sf, "documents").select("doc_id", "text")

    def digest(rows):
        read = with_digests(rows.drop("md5", "sha1", "sha256").join(content, "doc_id"), "text", key="content")
        done = read.select("doc_id", "content", F.struct("md5", "sha1", "sha256").alias("new"))
        return rows.join(done, "doc_id")

    def decode(hashes):
        h = F.col("content_hash")
        return hashes.select(h, F.lit(1).cast("int").alias("width"), F.lit(2).cast("int").alias("height"), F.sha2(F.concat(F.lit("n"), h), 256).alias("rothash"), h.alias("blockhash"))

    listing = fx.docs_files(spark, sf).select("doc_id", "path", "inode", "size", "mtime_ns", "error")
    return index.run_index(listing, src.Index(fx.files_old(spark, sf), fx.images_tbl(spark, sf), fx.extra_tbl(spark, sf)), digest, decode)


@query(_RUN + """SELECT m.path, status, m.content_hash, CASE WHEN whole THEN m.md5 ELSE md5(text) END AS md5, CASE WHEN whole THEN m.sha256 ELSE sha256(text) END AS sha256,
  CASE WHEN m.path NOT IN (SELECT path FROM photos) THEN NULL WHEN i.content_hash IS NULL THEN 1 ELSE i.width END AS width
FROM more m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN images_tbl i ON i.content_hash = m.content_hash""")
def q_index_run(spark, sf):
    return _index_run(spark, sf)[0].select("path", "status", "content_hash", "md5", "sha256", "width")


@query(_RUN + """SELECT path, inode, size, mtime_ns, content_hash FROM files_old WHERE path NOT IN (SELECT path FROM hashed WHERE status <> 'unchanged')
UNION ALL SELECT path, inode, size, mtime_ns, content_hash FROM hashed WHERE status <> 'unchanged'""")
def q_index_run_files(spark, sf):
    return _index_run(spark, sf)[1].files


@query(_RUN + """SELECT DISTINCT content_hash FROM (SELECT content_hash FROM more WHERE NOT whole UNION ALL SELECT content_hash FROM extra_tbl)""")
def q_index_run_extra(spark, sf):
    return _index_run(spark, sf)[1].extra.select("content_hash")


@query("""SELECT path, error FROM docs_files WHERE error IS NOT NULL AND regexp_extract(path, '[^/]+$') <> '.picasa.ini' AND NOT starts_with(regexp_extract(path, '[^/]+$'), '._')""")
def q_index_run_failed(spark, sf):
    return _index_run(spark, sf).failed


# --- matching ------------------------------------------------------------------------------------

_FIND = """SELECT d.path, coalesce(m, '') AS matches FROM docs_files d LEFT JOIN (SELECT path, string_agg(other, '|' ORDER BY other) AS m
FROM (SELECT DISTINCT path, other FROM pairs {w}) GROUP BY path) p ON p.path = d.path WHERE is_src"""


@query(_FIND.format(w=""))
def q_find(spark, sf):
    return match.find_matches(*_sides(spark, sf)).select("path", _joined("matches").alias("matches"))


@query(_FIND.format(w="WHERE kind = 0"))
def q_find_exact(spark, sf):
    return match.find_matches(*_sides(spark, sf), exact=True).select("path", _joined("matches").alias("matches"))


_SIZES = "(SELECT kind, hash, count(DISTINCT path) AS n_paths FROM melted WHERE NOT is_src GROUP BY ALL)"


@query(f"SELECT DISTINCT m.path, CAST(m.kind AS INT) AS kind, m.hash, n_paths FROM melted m JOIN {_SIZES} d ON d.kind = m.kind AND d.hash = m.hash WHERE is_src")
def q_find_classes(spark, sf):
    return match.find_classes(*_sides(spark, sf))


@query("SELECT DISTINCT CAST(kind AS INT) AS kind, hash, path FROM melted WHERE NOT is_src")
def q_class_members(spark, sf):
    return match.class_members(_sides(spark, sf)[1])


@query(f"""SELECT t.path, t.tier, m.hash, n_paths FROM tiers t LEFT JOIN melted m ON m.path = t.path AND m.kind = t.tier AND m.is_src
LEFT JOIN {_SIZES} d ON d.kind = m.kind AND d.hash = m.hash""")
def q_diff_classes(spark, sf):
    return match.diff_classes(*_sides(spark, sf))


@query("SELECT path, tier FROM tiers")
def q_diff_tiers(spark, sf):
    return match.diff_tiers(*_sides(spark, sf))


@query("""SELECT t.path, t.tier, string_agg(other, '|' ORDER BY other) AS matches FROM tiers t JOIN pairs p ON p.path = t.path AND p.kind = t.tier GROUP BY ALL""")
def q_diff_matches(spark, sf):
    return match.diff(*_sides(spark, sf)).where("tier IS NOT NULL").select("path", "tier", _joined("matches").alias("matches"))


@query("SELECT CAST(s.vec_id AS VARCHAR) AS path, CAST(min(kind) AS INT) AS tier FROM grids_src s LEFT JOIN grid_tiers t ON t.vec_id = s.vec_id GROUP BY ALL")
def q_diff_tiers_grids(spark, sf):
    return match.diff_tiers(*_grid_sides(spark, sf))


@query("""SELECT CAST(vec_id AS VARCHAR) AS path, CAST(kind AS INT) AS tier, string_agg(CAST(other AS VARCHAR), '|' ORDER BY CAST(other AS VARCHAR)) AS matches FROM grid_tiers t
WHERE kind = (SELECT min(kind) FROM grid_tiers u WHERE u.vec_id = t.vec_id) GROUP BY ALL""")
def q_diff_matches_grids(spark, sf):
    return match.diff(*_grid_sides(spark, sf)).where("tier IS NOT NULL").select("path", "tier", _joined("matches").alias("matches"))


@query("SELECT path FROM tiers WHERE tier IS NULL")
def q_missing(spark, sf):
    return match.missing(*_sides(spark, sf))


@query("SELECT path FROM docs_files WHERE is_src AND path NOT IN (SELECT path FROM pairs WHERE kind = 0)")
def q_missing_exact(spark, sf):
    return match.missing(*_sides(spark, sf), exact=True)


@query("""SELECT CAST(kind AS INT) AS kind, hash, count(DISTINCT path) AS n_paths, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM melted WHERE NOT is_src GROUP BY ALL""")
def q_hash_index(spark, sf):
    return match.hash_index(_sides(spark, sf)[1]).select("kind", "hash", F.size("paths").cast("long").alias("n_paths"), _joined("paths").alias("paths"))


@query("SELECT CAST(kind AS INT) AS kind, hash, count(DISTINCT path) AS n_paths FROM melted GROUP BY ALL HAVING count(DISTINCT path) > 1")
def q_duplicates(spark, sf):
    return match.duplicate_classes(fx.docs_files(spark, sf))


@query("SELECT CAST(kind AS INT) AS kind, hash, count(DISTINCT path) AS n_paths, string_agg(DISTINCT path, '|' ORDER BY path) AS paths FROM melted WHERE NOT is_src GROUP BY ALL")
def q_posting_chunks(spark, sf):
    """Chunks of two paths on average, put together again for the comparison."""
    chunks = match.posting_chunks(_sides(spark, sf)[1], chunk=2)
    whole = chunks.groupBy("kind", "hash").agg(F.array_sort(F.flatten(F.collect_list("paths"))).alias("paths"))
    return whole.select("kind", "hash", F.size("paths").cast("long").alias("n_paths"), _joined("paths").alias("paths"))


@query("SELECT path, CAST(kind AS INT) AS kind, other FROM pairs")
def q_find_chunks(spark, sf):
    return match.find_chunks(*_sides(spark, sf)).select("path", "kind", F.explode("paths").alias("other"))


@query("SELECT t.path, t.tier, other FROM tiers t JOIN pairs p ON p.path = t.path AND p.kind = t.tier")
def q_diff_chunks(spark, sf):
    return match.first_tier_chunks(*_sides(spark, sf)).select("path", "tier", F.explode("paths").alias("other"))


# --- commands that stop at the first failure, over sound listings --------------------------------

def _sound_sides(spark, sf):
    return tuple(d.where("error IS NULL") for d in _sides(spark, sf))


@query(_FIND.format(w="").replace("docs_files", "sound_files").replace("pairs", "sound_pairs"))
def q_command_find(spark, sf):
    return commands.find(*_sound_sides(spark, sf)).select("path", _joined("matches").alias("matches"))


@query("""SELECT t.path, t.tier, coalesce(string_agg(other, '|' ORDER BY other), '') AS matches FROM sound_tiers t LEFT JOIN sound_pairs p ON p.path = t.path AND p.kind = t.tier GROUP BY ALL""")
def q_command_diff(spark, sf):
    return commands.diff(*_sound_sides(spark, sf)).select("path", "tier", F.coalesce(_joined("matches"), F.lit("")).alias("matches"))


@query("SELECT path FROM sound_tiers WHERE tier IS NULL")
def q_command_missing(spark, sf):
    return commands.missing(*_sound_sides(spark, sf))


@query("""SELECT p.path, CASE WHEN doc_id % 2 = 0 THEN 'recorded as failed photo but looks valid now' ELSE 'bad marker' END AS verdict
FROM photos p JOIN images_tbl i ON i.content_hash = p.h0 WHERE (width IS NULL OR height IS NULL) AND p.error IS NULL""")
def q_command_broken(spark, sf):
    d = fx.docs_files(spark, sf).where("error IS NULL").withColumn("content_hash", F.col("h0"))
    ok = F.col("doc_id") % 2 == 0
    return commands.broken(d.select("path", "size", "content_hash", "error"), fx.images_tbl(spark, sf), d.select("path", ok.alias("ok"), F.when(~ok, "bad marker").alias("cause")))


# --- audit ---------------------------------------------------------------------------------------

_VALIDATE = """SELECT o.path, CASE WHEN o.content_hash <> f.content_hash THEN 'Blake3Mismatch' WHEN i.content_hash IS NULL OR i.width IS NULL OR i.height IS NULL THEN NULL
  WHEN NOT decode_ok THEN 'FailedDecode' WHEN o.width IS DISTINCT FROM i.width OR o.height IS DISTINCT FROM i.height THEN 'DimensionsMismatch'
  WHEN o.rothash IS DISTINCT FROM i.rothash THEN 'JpegRothashMismatch' WHEN o.blockhash IS DISTINCT FROM i.blockhash THEN 'Blockhash256Mismatch' END AS reason
FROM observed o JOIN files_old f ON f.path = o.path LEFT JOIN images_tbl i ON i.content_hash = f.content_hash"""


def _failures(spark, sf):
    return audit.validate(fx.observed(spark, sf), fx.files_old(spark, sf), fx.images_tbl(spark, sf))


@query(f"SELECT path, reason FROM ({_VALIDATE}) WHERE reason IS NOT NULL")
def q_validate(spark, sf):
    return _failures(spark, sf)


@query(f"SELECT path, reason FROM ({_VALIDATE}) WHERE reason IS NOT NULL AND path IN (SELECT path FROM sound_files)")
def q_command_validate(spark, sf):
    sound = fx.docs_files(spark, sf).where("error IS NULL").select("path", "error")
    return commands.validate(fx.observed(spark, sf).join(sound, "path"), fx.files_old(spark, sf), fx.images_tbl(spark, sf))


@query(f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM ({_VALIDATE}) WHERE reason IS NOT NULL GROUP BY reason")
def q_failure_counts(spark, sf):
    return audit.failure_counts(_failures(spark, sf))


@query("SELECT path, doc_id % 31 > 1 AS stable FROM docs_files")
def q_stable(spark, sf):
    return stable(*fx.before_after(spark, sf))


@query("""SELECT path, array_to_string(list_filter(['a', 'b', 'c'], lambda x: NOT list_contains(l, x)), '|') AS missing_in
FROM (SELECT path, list(listing) AS l FROM every_listing GROUP BY path) WHERE len(l) < 3""")
def q_reconcile_missing(spark, sf):
    return audit.reconcile_missing(fx.listings(spark, sf)).select("path", _joined("missing_in").alias("missing_in"))


@query("""SELECT e.path, e.listing, field FROM every_listing e JOIN (SELECT path, min(listing) AS base FROM every_listing GROUP BY path) m ON m.path = e.path
JOIN every_listing b ON b.path = e.path AND b.listing = m.base, (SELECT unnest(['inode', 'size', 'mtime_ns']) AS field)
WHERE (field = 'inode' AND e.inode <> b.inode) OR (field = 'size' AND e.size <> b.size) OR (field = 'mtime_ns' AND e.mtime_ns <> b.mtime_ns)""")
def q_reconcile_diff(spark, sf):
    return audit.reconcile_differences(fx.listings(spark, sf))


_PREFIX = """SELECT CAST(CASE count(*) WHEN 0 THEN 0 ELSE coalesce(max(p), 0) + 1 END AS BIGINT) AS n FROM (SELECT h, len(list_filter(range(1, 65),
  lambda i: left(h, i) = left(g, i))) AS p FROM (SELECT h, lag(h) OVER (ORDER BY h) AS g FROM (SELECT DISTINCT {c} AS h FROM {t})))"""


@query(_PREFIX.format(c="h0", t="docs_files"))
def q_min_unique(spark, sf):
    return min_unique_prefix(fx.docs_files(spark, sf), "h0")


@query(_PREFIX.format(c="content_hash", t="images_tbl"))
def q_min_unique_images(spark, sf):
    return min_unique_prefix(fx.images_tbl(spark, sf), "content_hash")


@query("""SELECT h AS hash, g AS previous, CAST(CASE WHEN g IS NULL THEN 0 ELSE len(list_filter(range(1, 65), lambda i: left(h, i) = left(g, i))) END AS INT) AS common
FROM (SELECT h, lag(h) OVER (ORDER BY h) AS g FROM (SELECT DISTINCT h0 AS h FROM docs_files))""")
def q_hash_neighbours(spark, sf):
    return hash_neighbours(fx.docs_files(spark, sf), "h0")


@query(_PREFIX.format(c="h0", t="docs_files"))
def q_min_unique_halving(spark, sf):
    return min_unique_by_halving(fx.docs_files(spark, sf), "h0")


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def q_first_seen_filtered(spark, sf):
    """Documents in four versions, each against the hashes before it: only possible hits of the merged filter are looked up."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    seen, known = None, None
    for k in range(4):
        batch = docs.where(F.col("doc_id") % 4 == k).select("content_hash")
        new = cut(batch.distinct() if seen is None else first_seen(batch, seen, known), "first-seen")
        more = seen_filter(new)
        seen, known = (new, cut(more, "filter")) if seen is None else (seen.unionByName(new), cut(merge_filters(known, more), "filter"))
    return seen


# --- streams: the table as a file stream, drained ------------------------------------------------

def _drained(spark, sf, name, run):
    """Run a stream over one table's file(s) and give what it left behind."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(fx.table(spark, sf, name).schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 2).parquet(f"{sf}/{name}.parquet*")
    return run(stream, folder)


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def q_stream_first_seen(spark, sf):
    def run(stream, folder):
        hashes = index_stream.new_contents_stream(stream.select(F.sha2("text", 256).alias("content_hash")))
        q = hashes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema("content_hash string").parquet(f"{folder}/out")

    return _drained(spark, sf, "documents", run)


@query("""SELECT path, max(seq) AS seq, arg_max(value, seq) AS value FROM event_rows GROUP BY path""")
def q_stream_index(spark, sf):
    def run(stream, folder):
        rows = stream.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), F.col("event_id").alias("seq"), "value")
        index_stream.start(index_stream.latest_stream(rows, ["path"], "seq"), folder).awaitTermination()
        return index_stream.current_rows(spark, folder)

    return _drained(spark, sf, "events", run)


@query("""SELECT path, inode, size, mtime_ns, h0 AS content_hash FROM docs_files WHERE error IS NULL
UNION ALL SELECT path, inode, size, mtime_ns, content_hash FROM files_old WHERE path NOT IN (SELECT path FROM docs_files WHERE error IS NULL)""")
def q_stream_classify(spark, sf):
    """The index of files kept from a stream of listing rows: each row is classified against the state of its path, and new and changed files are digested."""
    def run(stream, folder):
        listing = fx.as_files(stream).select("path", "inode", "size", "mtime_ns", "error", "text")
        changed = index_stream.index_stream(listing, lambda row: hashlib.sha256(row["text"].encode()).hexdigest(), fx.files_old(spark, sf))
        index_stream.start(changed, folder).awaitTermination()
        return index_stream.current_rows(spark, folder).select(*FILES.names)

    return _drained(spark, sf, "documents", run)


@query("SELECT path, status, h0 AS content_hash FROM classified WHERE error IS NULL AND status <> 'unchanged'")
def q_stream_changes(spark, sf):
    """What such a stream gives out: new and changed files only."""
    def run(stream, folder):
        listing = fx.as_files(stream).select("path", "inode", "size", "mtime_ns", "error", "text")
        changed = index_stream.index_stream(listing, lambda row: hashlib.sha256(row["text"].encode()).hexdigest(), fx.files_old(spark, sf))
        index_stream.start(changed, folder).awaitTermination()
        return spark.read.parquet(f"{folder}/changes").select("path", "status", "content_hash")

    return _drained(spark, sf, "documents", run)
