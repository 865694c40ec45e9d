"""From raw documents to token ids: language, boilerplate lines, near-duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps; all but the last
return the columns of ``documents``, further columns of ``docs`` untouched, whatever their
names.  Empty tables give empty results.  Repeated rows share their fate, but for
near_duplicates, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.bpe_transducer import round_trip
from tallyfold.llm.common import cut, read
from tallyfold.llm.edit_windows import without_contaminated
from tallyfold.llm.language_id import identified
from tallyfold.llm.line_templates import drop_recurring_lines
from tallyfold.llm.weighted_near_dup import keep_one_of_each_class

#: SQL can express none of the stages' models; the tests hold each stage and the whole against brute force.
ORACLE_SQL = None


def _safe(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names that no operator uses, and the new name of each column."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(kept: DataFrame, names: dict[str, str]) -> DataFrame:
    return kept.select(*[F.col(safe).alias(c) for c, safe in names.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the corpus's languages.  A text without letters (null, empty, signs only) is in none."""
    safe, names = _safe(docs)
    return _restored(identified(safe, names["text"], names["lang"], names["source"]).where("accepted"), names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; rows of which nothing is left go.  ``n_chars`` follows a text that changes.  Null and
    empty texts have no lines and stay."""
    safe, names = _safe(docs)
    text = names["text"]
    cleaned = drop_recurring_lines(safe, names["doc_id"], text).where((F.col("n_dropped") == 0) | (F.trim(text) != ""))
    if "n_chars" in names:
        n = names["n_chars"]
        cleaned = cleaned.withColumn(n, F.when(F.col("n_dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return _restored(cleaned, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one with the smallest id; a null id stands in only where a class has no
    other.  Texts without a word (null, empty, blank) are in no class and all stay."""
    safe, names = _safe(docs)
    return _restored(keep_one_of_each_class(safe, names["doc_id"], names["text"]), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark.  Null and empty texts hold none; neither do items without a word count."""
    safe, names = _safe(docs)
    return _restored(without_contaminated(safe, read(spark, sf_dir, "benchmark"), names["text"]), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids and whether they decode to the text again.  A null text is the empty one, without ids."""
    safe, names = _safe(docs)
    done = round_trip(safe, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), names["text"], keep=[names["doc_id"]])
    return done.select(
        F.col(names["doc_id"]).alias("doc_id"), "n_tokens", F.hex("ids").alias("ids_hex"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "valid_utf8"
    )


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
