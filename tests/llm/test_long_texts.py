"""Texts of a megabyte, with and without spaces, through the operators: whole results, nothing cut off."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import brute_rules

from tallyfold.llm import context_mixing, edit_windows, isolation_rules, language_id, line_templates, piece_backtracking, source_divergence, suffix_repeats, weighted_near_dup

SF = "/root/testdata/sf0.001"
WORDY, COPY, LETTERS, LINES = 10_001, 10_002, 10_003, 10_004


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    words = [f"word{rng.randrange(5000)}" for _ in range(110_000)]
    near = list(words)
    for k in range(0, len(near), 900):
        near[k] = "changed"
    rows = [
        (WORDY, " ".join(words) + " " + item, "en", "long"), (COPY, " ".join(near), "en", "long"), (LETTERS, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), None, "long"),
        (LINES, "\n".join(f"line {rng.randrange(10**6)} of text {'x' * (k % 40)}" for k in range(25_000)), "en", None),
    ]
    assert all(len(r[1]) > 500_000 for r in rows)
    return table.unionByName(spark.createDataFrame(rows, table.schema)).repartition(4).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language_and_scores(docs):
    n = docs.count()
    got = by_id(language_id.identified(docs))
    assert len(got) == n and got[WORDY]["language"] == "en" and got[WORDY]["text"] is not None
    scores = by_id(context_mixing.language_model_scores(docs.select("doc_id", "text")))
    assert len(scores) == n and scores[WORDY]["n_tokens"] > 110_000 and scores[LETTERS]["n_tokens"] == 2
    assert all(r["score"] < 0 and 0 < r["bits_per_byte"] < 40 for r in scores.values())


def test_rules(spark, docs):
    got = by_id(isolation_rules.quality_verdicts(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    texts = by_id(docs)
    for k in (WORDY, LETTERS, LINES):
        assert tuple(got[k][c] for c in isolation_rules.BASE) == brute_rules(texts[k]["text"])


def test_windows_to_the_end(spark, docs):
    first = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(1)
    got = by_id(edit_windows.found_items(docs.select("doc_id", "text"), first))
    assert [h["edits"] for h in got[WORDY]["found"]] == [0] and got[WORDY]["found"][0]["word"] >= 110_000 and not got[LETTERS]["found"]


def test_near_copies_and_lines(docs):
    got = by_id(weighted_near_dup.near_duplicate_classes(docs.select("doc_id", "text")))
    assert got[WORDY]["class_id"] == got[COPY]["class_id"] == WORDY and got[LETTERS]["class_size"] == 1
    lines = by_id(line_templates.drop_recurring_lines(docs.select("doc_id", "text")))
    assert lines[LINES]["n_lines"] == 25_000 and lines[LETTERS]["text"] == by_id(docs)[LETTERS]["text"]


def test_repeats_across_long_texts(docs):
    long = docs.where(F.col("doc_id").isin(WORDY, COPY)).select("doc_id", "text")
    got, texts = by_id(suffix_repeats.without_repeats(long)), by_id(long)
    assert bytes(got[WORDY]["kept"]).decode() == texts[WORDY]["text"]
    assert 110 < got[COPY]["kept"].count(b"changed") and len(got[COPY]["kept"]) < 30_000


def test_divergence_and_pieces(docs):
    rows = source_divergence.source_divergence(docs, min_df=2).where("part = 'pair' AND lang = 'en' AND source = 'long'").collect()
    assert rows and sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got, texts = by_id(piece_backtracking.piece_round_trip(docs.select("doc_id", "text"), path)), by_id(docs)
    for k in (WORDY, LETTERS, LINES):
        assert got[k]["ids"] == library.encode(texts[k]["text"]) and got[k]["decoded"] == texts[k]["text"]
