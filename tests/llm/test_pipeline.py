"""Each stage of the pipeline, and the whole, against brute force; odd tables."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import bpe_transducer, language_id, line_templates, shingles, weighted_near_dup

from test_operators import brute_classes, brute_edits

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, as extra columns of a caller.
CLASH = ["language", "accepted", "posterior", "n_lines", "n_dropped", "found", "__drop", "__node", "__host", "node", "label", "row", "key", "c0", "hash"]


def folded(text):
    return "".join(c if c.isalnum() and ord(c) < 128 or ord(c) >= 128 else " " for c in text.casefold()).split()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables: prose of the small tables with planted lines, copies, near copies, leaks and junk."""
    rng, folder = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    prose = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if 80 < len(r["text"].split()) < 400][:70]
    bench = [r for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()][:30]
    rows = []
    for i, r in enumerate(prose):
        text = r["text"] + ("\nSubscribe to our weekly letter today for more\n" if i % 4 == 0 else "") + (f"\nPage {i} of 900 in this long report" if i % 3 == 0 else "")
        rows.append((i, text, r["lang"], r["source"], len(text)))
    for i in (3, 5, 5, 9):  # copies and near copies
        words = rows[i][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows += [(100 + len(rows), rows[i][1], *rows[i][2:]), (100 + len(rows), " ".join(words), *rows[i][2:])]
    for k, r in enumerate(bench[:6]):  # leaks, one with an edit
        words = r["text"].split()
        if k % 2 and len(words) > 9:
            words[4] = "edited"
        text = f"{prose[20 + k]['text']} {' '.join(words)}"
        rows.append((300 + k, text, prose[20 + k]["lang"], "src1", len(text)))
    rows += [(400 + i, t, None, None, None) for i, t in enumerate([None, "", " \n", "12345 !!! 999", "q" * 40_000, "zxq " * 3])] + [(None, None, None, None, None), rows[0]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r["item_id"], r["text"]) for r in bench], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def brute_lines(rows):
    """Texts less recurring lines: every leaf parsed at once, in one process."""
    of, docs = {}, {}
    for n, (k, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if w := line_templates.tokens(line):
                docs.setdefault((len(w), tuple(w[: line_templates.DEPTH]), " ".join(w)), set()).add(n)
    leaves = {}
    for size, lead, line in docs:
        leaves.setdefault((size, lead), []).append(line)
    for (size, lead), found in leaves.items():
        # Rows that repeat another are counted with it as one in the order of lines.
        times = [len({rows[n] for n in docs[size, lead, x]}) for x in found]
        for x, t in zip(found, line_templates.leaf_templates(found, times)):
            of[size, lead, x] = (size, lead, t)
    members = {}
    for x, t in of.items():
        members.setdefault(t, set()).update(docs[x])
    out = []
    for n, (k, t) in enumerate(rows):
        kept = []
        for line in (t or "").split("\n"):
            w = line_templates.tokens(line)
            who = members[of[len(w), tuple(w[: line_templates.DEPTH]), " ".join(w)]] if w else ()
            keep = min((rows[m][0] for m in who if rows[m][0] is not None), default=None)
            if len(who) < line_templates.MIN_DOCS or k == keep:
                kept.append(line)
        out.append(t if t is None or kept == t.split("\n") else "\n".join(kept))
    return out


def test_language_has_one_python_step(spark, made):
    """Two Python steps in a row take two workers a core, which later stages keep; one pass gives what two gave."""
    docs = spark.read.parquet(f"{made}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, made)
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = language_id.identified(docs, keep_text=False).select("doc_id", "language", "posterior", "accepted")
    once = language_id.identified(docs).select("doc_id", "language", "posterior", "accepted")
    assert Counter(map(tuple, apart.collect())) == Counter(map(tuple, once.collect()))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in apart.where("accepted").collect())


def test_tables_that_near_duplicates_hold_are_small():
    assert shingles.PIECE * 16 <= 4 << 20 and sum(x.nbytes for x in weighted_near_dup._draws()) <= 25.5e6


def test_lines_against_brute_force(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((k, t) for (k, before), t in zip(rows, brute_lines(rows)) if t == before or t.strip(" "))
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.lines(spark, docs, made).collect()) == want
    assert sum(a != b for (_, a), b in zip(rows, brute_lines(rows))) > 20


def test_near_duplicates_against_brute_force(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    classes = brute_classes([t or "" for _, t in rows])
    best = {}
    for (k, t), c in zip(rows, classes):
        if (t or "").strip():
            best[c] = min(best.get(c, k), k)
    want = Counter([k for k in best.values()] + [k for k, t in rows if not (t or "").strip()])
    got = Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, made).collect())
    assert got == want and sum(want.values()) < len(rows) - 6


def test_decontamination_against_brute_force(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    items = [folded(r["text"]) for r in spark.read.parquet(f"{made}/benchmark.parquet").collect()]
    kept = Counter(r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, made).collect())
    for r in docs.collect():
        words, hit = folded(r["text"] or ""), False
        for item in items:
            m, most = len(item), len(item) // 5
            common = set(item)
            for a in range(max(len(words) - m, 0) + 1):
                window = words[a : a + m]
                if sum(w in common for w in window) >= m - most and brute_edits(window, item) <= most:
                    hit = True
                    break
        assert (kept[r["doc_id"]] == 0) == hit or r["doc_id"] is None or r["doc_id"] == 0, r["doc_id"]


def test_the_whole(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, made).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_transducer.read_ranks(path), special_tokens={})
    want = {r["doc_id"]: (library.encode_ordinary(r["text"]), hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect()}
    got = corpus_pipeline.run(spark, made).collect()
    assert {r["doc_id"]: ([int.from_bytes(bytes.fromhex(r["ids_hex"])[i : i + 4], "little") for i in range(0, 4 * r["n_tokens"], 4)], r["decoded_sha256"]) for r in got} == want
    assert not {400, 401, 402, 403, 404, None} & set(want) and not set(range(300, 306)) & set(want)
    assert len(want) > 40 and len(got) == len(want)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_clashing_columns_and_stand_odd_tables(spark, made, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{made}/documents.parquet")
    clash = docs.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})
    got = stage(spark, clash, made)
    plain = stage(spark, docs, made)
    assert got.count() == plain.count()
    if name != "encode":
        assert got.columns == clash.columns
        assert got.where(" OR ".join(f"`{c}` <> concat('{c}', coalesce(cast(doc_id as string), '-'))" for c in CLASH)).count() == 0
    assert stage(spark, docs.where("false"), made).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert stage(spark, nulls, made).count() == (0 if name == "language" else 3)
