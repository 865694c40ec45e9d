"""Pre-tokens of any length: equal to the libraries, in linear time and bounded memory."""

import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyfold.llm import bpe_transducer, token_counts

COUNTS, IDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "etaoin", "日本é", "a=-_", "aAbB"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(IDS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_places_by_rank_equal_rounds():
    table, rng = token_counts.MergeTable(COUNTS), random.Random(2)
    words = ["".join(rng.choices(ALPHABETS[k % 7], k=rng.randint(1, 90))).encode() for k in range(1500)]
    assert [table.long_count(w) for w in words] == table.counts(words).tolist()


def test_long_and_short_words_together(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 5)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(1, 30))) for _ in range(20)) for _ in range(60)]
    library = Tokenizer.from_file(COUNTS)
    assert token_counts.count_batch(texts, COUNTS) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("alphabet", ALPHABETS[:3])
def test_a_megabyte_without_a_space_is_counted(alphabet):
    text = "".join(random.Random(4).choices(alphabet, k=1_000_000))
    began = time.time()
    got = token_counts.count_batch([text], COUNTS)[0]
    assert time.time() - began < 30
    if alphabet != "a":
        assert got == len(Tokenizer.from_file(COUNTS).encode(text, add_special_tokens=False).ids)


def test_a_long_word_is_encoded_while_states_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "REMEMBERED_MOVES", 500)
    encoder, rng = bpe_transducer.Encoder(IDS), random.Random(5)
    for alphabet in ALPHABETS[:4]:
        text = "".join(rng.choices(alphabet, k=20_000))
        assert encoder.transducer.encode(text.encode()) == library.encode_ordinary(text)
        assert len(encoder.transducer.states) <= 502
