"""SentencePiece by backtracking: equal to the library, whatever the text."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import entries, piece_backtracking

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a ", "a\nb\r\n\tc", "▁", "▁▁x", "\0", "<s></s><0x41>", "ａｂ①é", "日本語の雲", "a" * 300, " " * 67, "🙂🙂 ok", "x​y"]


@pytest.fixture(scope="module")
def model():
    return piece_backtracking.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(model, library, texts):
    ids, edges = model.encode_all(texts)
    want = [library.encode(x) for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want
    assert [model.encode(x).tolist() for x in texts] == want
    assert model.decode_all(ids, edges).to_pylist() == [library.decode(w) for w in want]


def test_odd_texts(model, library):
    check(model, library, ODD)
    check(model, library, [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abehinrst ▁.,\n"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_any_text(model, library, texts):
    check(model, library, texts)


def test_pieces_at_random(model, library):
    rng = random.Random(4)
    pieces = list(model.ids)
    check(model, library, ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)])


def test_any_ids_decode(model, library):
    rng = random.Random(5)
    rows = [[rng.choice([0, 1, 2, 3 + rng.randrange(256), 259 + rng.randrange(20), rng.randrange(32000)]) for _ in range(rng.randint(1, 12))] for _ in range(3000)]
    for some in [rows, *[[a] for a in rows[:500]]]:
        got = model.decode_all(np.array(sum(some, [])), np.cumsum([0, *map(len, some)])).to_pylist()
        assert got == [library.decode(r) for r in some]
    with pytest.raises(ValueError):
        model.decode(np.array([32000]))


def test_failed_places_are_not_entered_again(model, library):
    """Long stretches without a cut: linear, with steps back."""
    rng = random.Random(6)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)), "ab" * 100_000, " " * 100_001):
        assert model.encode(text).tolist() == library.encode(text)


def test_windows_do_not_part_merges(model, library, monkeypatch):
    texts = [r for r in ODD if r] + ["the cat sat on the mat " * 20]
    want = [library.encode(x) for x in texts]
    for window in (1, 2, 7):
        monkeypatch.setattr(piece_backtracking, "WINDOW", window)
        assert [model.encode(x).tolist() for x in texts] == want


def test_memory_that_is_full_starts_anew(library, monkeypatch):
    monkeypatch.setattr(piece_backtracking, "REMEMBERED", 3)
    check(piece_backtracking.PieceModel(PATH), library, ODD + ["some words of more than three stretches"])


def test_frames(spark):
    rows = [(k, t, "x") for k, t in enumerate([*ODD, None, None])] + [(0, "", "x"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = piece_backtracking.piece_round_trip(df.select("doc_id", "text"), PATH)
    got = made.collect()
    assert len(got) == len(rows) and all(r["n_tokens"] == len(r["ids"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[len(ODD)]["ids"] == [] and by[len(ODD)]["decoded"] == ""
    alone = piece_backtracking.encode_pieces(df, PATH, keep=["doc_id"])
    again = piece_backtracking.decode_pieces(alone, PATH)
    assert {(r["doc_id"], r["decoded"]) for r in again.collect()} == {(r["doc_id"], r["decoded"]) for r in got}
    assert piece_backtracking.piece_round_trip(df.where("false").select("doc_id", "text"), PATH).count() == 0
    with pytest.raises(ValueError):
        piece_backtracking.decode_pieces(alone, PATH, made="ids")


def test_op13_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = entries.queries()["op13_merge_backtracking"](spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
