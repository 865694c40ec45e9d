"""Divergence of sources against its definition."""

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import entries, source_divergence

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_df, top):
    rows = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for r in mine for t in set(r[2]))
        kept = [t for t, n in df.items() if n >= min_df]
        v = len(kept)

        def shares(of):
            n = Counter(t for r in of for t in r[2])
            total = sum(n[t] for t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * v) for t in kept}

        whole = shares(mine)[1]
        groups = {s: shares([r for r in mine if r[1] == s]) for s in {r[1] for r in mine}}
        for s, (n, p) in groups.items():
            pairs = [(sum(abs(p[t] - q[t]) for t in kept), x) for x, (_, q) in groups.items() if x != s]
            words = [(p[t] - whole[t], t) for t in kept if n[t] > 0 and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, value, k + 1) for k, (value, x) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


ROWS = [
    ("en", "a", "The cat ÄÖ the dog"), ("en", "a", "cat-cat dog 7x7"), ("en", "b", "the Dog the"), ("en", "c", None), ("en", None, "cat the\0bird"), ("en", "", "bird"),
    ("de", "a", "der Hund Äpfel"), ("de", "b", "äpfel der der"), (None, "a", "x y"), (None, "b", "x"), ("", "a", "x x"), ("fr", "z", ""), ("fr", "a", "seul"), ("en\0de", "a", "the"), ("en\0de", "b", "the the"),
] + [("en", f"s{k}", "the cat " * (k % 3) + f"日本 w{k % 4}") for k in range(12)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS + ROWS[:3], "lang string, source string, text string")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["", "en", "日", "en\0x"]), st.text(st.one_of(st.sampled_from("abZ 0-é日\0"), st.characters(exclude_categories=["Cs"])), max_size=12)), max_size=6))
def test_terms_against_the_pattern(rows):
    langs, texts = [r[0] for r in rows], [r[1] for r in rows]
    want = [[f"{lang}\0" + re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)] for lang, text in rows]
    assert source_divergence.led_terms(langs, pa.array(texts, pa.string())).to_pylist() == want
    assert source_divergence.led_terms(langs[1:], pa.array(texts, pa.string())[1:]).to_pylist() == want[1:]


def test_against_definition(spark, small):
    for min_df, top in ((1, 50), (2, 2)):
        assert rows_of(source_divergence.source_divergence(small, min_df=min_df, top=top)) == brute(ROWS + ROWS[:3], min_df, top)


def test_in_tiles_and_pieces(small, monkeypatch):
    want = brute(ROWS + ROWS[:3], 1, 50)
    monkeypatch.setattr(source_divergence, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(source_divergence, "BLOCK_TERMS", 2)
    monkeypatch.setattr(source_divergence, "PIECE_TERMS", 7)
    monkeypatch.setattr(source_divergence, "SAMPLED", 1)
    assert rows_of(source_divergence.source_divergence(small, min_df=1)) == want


def test_terms_said_often_are_few_entries(spark):
    """What becomes vectors follows the different terms of a task's groups, not how often they occur."""
    docs = spark.createDataFrame([("en", "a", "the cat " * 1000), ("en", "a", "the " * 47), ("en", "b", "cat"), ("de", "a", ""), ("de", "b", "the the")], "lang string, source string, text string").coalesce(1)
    rows = source_divergence.term_rows(docs).collect()
    assert sorted(sorted(r["terms"]) for r in rows if r["terms"] is not None) == [[], ["de\0the"], ["en\0cat"], ["en\0cat", "en\0the"], ["en\0the"]]
    bags = [r for r in rows if r["bag"] is not None]
    got = Counter()
    for r in bags:
        assert len(set(r["bag"])) == len(r["bag"])
        got.update({(r["lang"], r["source"], t): 1 << r["power"] for t in r["bag"]})
    assert got == {("en", "a", "en\0the"): 1047, ("en", "a", "en\0cat"): 1000, ("en", "b", "en\0cat"): 1, ("de", "b", "de\0the"): 2}
    assert sum(len(r["bag"]) for r in bags) == 5 + 6 + 1 + 1


def test_terms_are_drawn_by_themselves():
    words = pa.array([f"en\0{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}é" for a in range(26) for b in range(26) for c in range(26)])
    drawn = source_divergence._drawn(words, 8)
    assert (source_divergence._drawn(words[5000:], 8) == drawn[5000:]).all() and source_divergence._drawn(words, 1).all()
    assert 0.5 < drawn.mean() * 8 < 1.5 and not len(source_divergence._drawn(words[:0], 8))


def test_sums_in_blocks(small, monkeypatch):
    """Sums that a task hands on before its end, of many blocks."""
    schema = "lang string, source string, block long, places binary, n binary"
    rows = source_divergence.term_rows(small.fillna("").select("lang", "source", "text")).cache()
    words, sums = source_divergence.vocabulary_and_sums(rows, 1)
    want = Counter((x or "", y or "", f"{x or ''}\0" + re.sub("[A-Z]", lambda m: m[0].lower(), t)) for x, y, text in ROWS + ROWS[:3] for t in TERM.findall(text or ""))
    names = {r["id"]: f"{r['lang']}\0{r['term']}" for r in words.collect()}
    assert {(r["lang"], r["source"], names[r["id"]]): r["n"] for r in sums.collect()} == want
    monkeypatch.setattr(source_divergence, "BLOCK_BITS", 2)
    monkeypatch.setattr(source_divergence, "HELD", 3)
    terms = sorted({t for _, _, t in want})
    vectors = [(x, y, k, [terms.index(t)]) for (x, y, t), n in want.items() for k in range(12) if n >> k & 1]
    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_arrays([pa.array([v[0]]), pa.array([v[1]]), pa.array([v[2]], pa.int32()), pa.array([{"indices": v[3], "values": [1.0]}], kind)], names=["lang", "source", "power", "vector"]) for v in vectors]
    packed = pa.Table.from_batches(list(source_divergence._sums(iter(batches))))
    assert packed.column_names == [x.split()[0] for x in schema.split(", ")] and len(set(packed["block"].to_pylist())) > 2
    packed = packed.sort_by([(c, "ascending") for c in ("lang", "source", "block")])
    out = pa.Table.from_batches(list(source_divergence._added(iter(packed.to_batches(max_chunksize=2)), 100)))
    assert {(r["lang"], r["source"], terms[r["id"] - 100]): r["n"] for r in out.to_pylist()} == want and len(out) == len(want)


def test_nothing_kept_and_nothing_there(small):
    got = rows_of(source_divergence.source_divergence(small, min_df=1000))
    assert got == brute(ROWS, 1000, 50) and {r[4] for r in got} == {0}
    assert source_divergence.source_divergence(small.where("false")).count() == 0


def test_other_names_and_columns(spark):
    df = spark.createDataFrame([(1, "en", "a", "x y", "t"), (2, "en", "b", "y", "u")], "sid long, value string, terms string, id string, text string")
    got = rows_of(source_divergence.source_divergence(df, "value", "terms", "id", min_df=1))
    assert got == brute([("en", "a", "x y"), ("en", "b", "y")], 1, 50)


def test_op11_against_sql_and_definition(spark):
    df = entries.queries()["op11_source_divergence"](spark, SF)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    got = rows_of(df)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()
    assert got == brute(docs, 30, 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(entries.oracle_sql()["op11_source_divergence"]).fetchall())
