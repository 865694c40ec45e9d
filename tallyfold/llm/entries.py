"""Registered queries of the text operators: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_transducer import round_trip
from .common import read
from .context_mixing import language_model_scores
from .edit_windows import found_items
from .isolation_rules import BASE, quality_verdicts
from .language_id import fit_text_model, page_declared, page_host, page_text, with_language
from .line_templates import drop_recurring_lines
from .piece_backtracking import piece_round_trip
from .range_shards import range_shards
from .source_divergence import source_divergence
from .suffix_repeats import without_repeats
from .token_counts import token_counts
from .weighted_near_dup import near_duplicate_classes
from .whitening import whitening


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source) and pages (markup language, host of the address)."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = docs.select("doc_id", none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host")).unionByName(
        pages.select(none.alias("doc_id"), "page_id", page_text(F.col("html")).alias("text"), page_declared(F.col("html")).alias("declared"), page_host(F.col("url")).alias("host"))
    )
    return with_language(rows, fit_text_model(docs, "text", "lang"), "text", "declared", "host", keep_text=False)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", *BASE, "base_failed", "kept", "anomaly")


def op4_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return range_shards(docs, key="text_crc32", tie="doc_id", size="size", shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_edit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_items(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.col("found.item_id").alias("item_ids"), F.col("found.edits").alias("edits"), F.col("found.word").alias("words"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op7_weighted_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "valid_utf8"
    )


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op12_shifted_cholesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_merge_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return piece_round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_context_mixing, op3_isolation_rules, op4_range_shards, op5_edit_windows, op6_token_counts, op7_weighted_near_dup, op8_bpe_transducer, op9_line_templates, op10_suffix_repeats, op11_source_divergence, op12_shifted_cholesky, op13_merge_backtracking)}


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(max(v), 0) AS v FROM d LEFT JOIN size ON size.lang = d.lang GROUP BY ALL),
gn AS (SELECT g.lang, g.source, v, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5) // (total + 5 * v) AS p
  FROM gn JOIN kept ON kept.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = kept.term),
whole AS (SELECT lang, sum(total) AS total, max(v) AS v FROM gn GROUP BY lang),
q AS (SELECT p.lang, term, 1 + CAST(1000000000 AS HUGEINT) * (CAST(sum(n) AS HUGEINT) + 5) // (max(total) + 5 * max(v)) AS q FROM p JOIN whole ON whole.lang = p.lang GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM gn a JOIN gn b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found) WHERE part = 'pair' OR rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL}
