"""Every registered query of the text operators on the small tables: columns and types of its contract, and its rows against a
brute-force version."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_classes, brute_rules, is_held, words
from test_pipeline import brute_lines
from tokenizers import Tokenizer

from tallyfold.llm import edit_windows, entries, isolation_rules, language_id

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_language_id": {"doc_id": "bigint", "page_id": "bigint", "language": "string", "posterior": "double", "accepted": "boolean"},
    "op2_context_mixing": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_isolation_rules": {"doc_id": "bigint", **dict.fromkeys(isolation_rules.BASE, "bigint"), "base_failed": "boolean", "kept": "boolean"},
    "op4_range_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_edit_windows": {"doc_id": "bigint", "contaminated": "boolean"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_weighted_near_dup": {"doc_id": "bigint", "class_id": "bigint", "class_size": "bigint"},
    "op8_bpe_transducer": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_line_templates": {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_dropped": "bigint"},
    "op13_merge_backtracking": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_suffix_repeats": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
}


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def of(name):
        if name not in made:
            df = entries.queries()[name](spark, SF)
            made[name] = df.dtypes, df.collect()
        return made[name]

    return of


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(TYPES))
def test_columns_and_rows(results, texts, name):
    types, rows = results(name)
    assert TYPES[name].items() <= dict(types).items()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted(texts)


def slow_fusion(model, rows):
    """Language and posterior of rows ``(text, declared, host)`` from the definition: text, declaration, and a host prior without
    the row itself."""
    scores, n = model.scores([(text or "").encode() for text, _, _ in rows])
    scores = scores.astype(np.float32).astype(float)
    languages, k = model.languages, len(model.languages)
    vote = [int(s.argmax()) if c and s.argmax() < k else None for s, c in zip(scores, n)]
    code = [None if said is None else languages.index(said.lower()) if said.lower() in languages else k for _, said, _ in rows]
    said, overall = np.full((k, k + 1), language_id.DECLARED_SMOOTH), np.ones(k)
    levels = [{}, {}, {}]
    parts = lambda host: (host.split(".")[-1], ".".join(host.split(".")[-2:]), host)
    for (_, _, host), v, c in zip(rows, vote, code):
        if v is None:
            continue
        overall[v] += 1
        if c is not None:
            said[v, c] += 1
        if host is not None:
            for level, name in zip(levels, parts(host)):
                level.setdefault(name, np.zeros(k))[v] += 1
    said = np.log(said / said.sum(axis=1, keepdims=True))
    out = []
    for (_, _, host), s, v, c, count in zip(rows, scores, vote, code, n):
        if not count:
            out.append(("und", 1.0))
            continue
        log, prior = s.copy(), overall / overall.sum()
        if host is not None:
            for level, name in zip(levels, parts(host)):
                seen = level.get(name)
                if seen is not None:
                    own = seen.copy()
                    if v is not None:
                        own[v] -= 1
                    prior = (own + language_id.STRENGTH * prior) / (own.sum() + language_id.STRENGTH)
        log[:k] += np.log(prior)
        log[k] -= math.log(k + 1)
        if c is not None:
            log[:k] += said[:, c]
            log[k] -= math.log(k + 1)
        p = np.exp(log - log.max())
        p /= p.sum()
        out.append(([*languages, "und"][int(p.argmax())], float(p.max())))
    return out


def test_op1_against_slow_fusion(spark, results):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    model = language_id.fit_text_model(docs, "text", "lang")
    rows = [("d", r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    rows += [("p", *r) for r in pages.select("page_id", language_id.page_text(F.col("html")), language_id.page_declared(F.col("html")), language_id.page_host(F.col("url"))).collect()]
    want = {r[:2]: x for r, x in zip(rows, slow_fusion(model, [r[2:] for r in rows]))}
    got = {("d", r["doc_id"]) if r["doc_id"] is not None else ("p", r["page_id"]): r for r in results("op1_language_id")[1]}
    assert set(got) == set(want)
    for key, (name, p) in want.items():
        assert got[key]["language"] == name and math.isclose(got[key]["posterior"], p, rel_tol=1e-4), key
        assert got[key]["accepted"] == (name != "und" and p >= language_id.ACCEPTED) or abs(p - language_id.ACCEPTED) < 1e-3


def test_stage_language_against_slow_fusion(spark):
    """The pipeline's first stage keeps what the definition accepts under a model of the rows' own labels."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "src0", 0), (90002, "12 34 !!", "en", None, 8), (90003, "the and of " * 9, None, None, 99)], docs.schema)
    both = docs.unionByName(odd)
    rows = both.collect()
    model = language_id.fit_text_model(both, "text", "lang")
    told = slow_fusion(model, [(r["text"], r["lang"], r["source"]) for r in rows])
    assert all(abs(p - language_id.ACCEPTED) > 1e-3 for _, p in told)  # none so close that rounding decides
    want = sorted(r["doc_id"] for r, (name, p) in zip(rows, told) if name != "und" and p >= language_id.ACCEPTED)
    kept = corpus_pipeline.language(spark, both, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert not {90001, 90002} & set(want) and len(want) > 0.8 * len(rows)


def test_op1_declarations_and_hosts_only_help(spark):
    """Held-out accuracy on short texts, with and without what was declared: labels of the rows that are asked about train nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL")
    train, rest = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    short = rest.withColumn("text", F.left("text", F.lit(3)))
    model = language_id.fit_text_model(train, "text", "lang")
    wrong = F.when(F.col("doc_id") % 5 == 1, "xx").otherwise(F.col("lang"))  # one declaration in five is of no use
    right = lambda df: df.agg(F.avg((F.col("lang") == F.col("language")).cast("int"))).first()[0]
    none = F.lit(None).cast("string")
    blind = language_id.with_language(short.withColumns({"said": none, "host": none}), model, declared="said", host="host")
    fused = language_id.with_language(short.withColumns({"said": wrong, "host": F.col("source")}), model, declared="said", host="host")
    assert right(fused) > right(blind) + 0.02 and right(fused) > 0.8


def test_op2_counts(results, texts):
    counts = Counter()
    for k, t in texts.items():
        if not is_held(k):
            counts.update(words(t))
    n, v = sum(counts.values()), len(counts)
    for r in results("op2_context_mixing")[1]:
        w = words(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / (len(texts[r["doc_id"]].encode()) + 1), rel_tol=1e-9)


def test_op3_counts_and_verdicts(spark, results, texts):
    rows = results("op3_isolation_rules")[1]
    for r in rows:
        n = brute_rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in isolation_rules.BASE) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r["kept"] or not r["base_failed"])
    # The threshold: what is kept is what scores below some value, and nothing below it is dropped.
    fine = [r for r in rows if not r["base_failed"]]
    kept, lost = [r["anomaly"] for r in fine if r["kept"]], [r["anomaly"] for r in fine if not r["kept"]]
    assert kept and (not lost or max(kept) < min(lost))


def test_paths_against_a_slow_walk():
    rng = np.random.default_rng(3)
    sample, asked = rng.normal(size=(200, 3)), rng.normal(size=(50, 3)) * 3
    forest = [isolation_rules.grow(sample[rng.choice(200, 64)], np.full(3, 0.1), seed) for seed in range(9)]

    def path(tree, x, node=0):
        feature, split, length = tree
        return length[node] if feature[node] < 0 else path(tree, x, 2 * node + (2 if x[feature[node]] > split[node] else 1))

    slow = [2 ** (-np.mean([path(t, x) for t in forest]) / isolation_rules.average_path(np.array([64]))[0]) for x in asked]
    assert np.allclose(isolation_rules.anomaly(asked, forest, 64), slow)
    inside = isolation_rules.anomaly(sample, forest, 64)
    assert isolation_rules.anomaly(np.full((1, 3), 9.0), forest, 64)[0] > inside.max()


def test_op4_shards(results, texts):
    rows, slots = results("op4_range_shards")[1], {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 16
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5_finds_items_at_the_limit(spark):
    items = [(r["item_id"], r["text"].replace(".", "").replace(",", "").split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng, rows, truth = random.Random(5), [], {}
    for k in range(400):
        i, w = rng.choice(items)
        w = list(w)
        for p in rng.sample(range(len(w)), edit_windows.edits_allowed(len(w))):
            w[p] = f"sub{rng.randrange(10**9)}"
        rows.append((k, "Some words before " * rng.randint(0, 5) + " ".join(w) + " and after" * rng.randint(0, 5)))
        truth[k] = i
    found = edit_windows.found_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    got = {r["doc_id"]: {x["item_id"] for x in r["found"]} for r in found.collect()}
    assert np.mean([truth[k] in got[k] for k in truth]) >= 0.88


def test_op6_counts(results, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in results("op6_token_counts")[1]:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_op7_classes(results, texts):
    ids = sorted(texts)
    of = dict(zip(ids, brute_classes([texts[k] for k in ids])))
    first, size = {}, Counter(of.values())
    for k in ids:
        first.setdefault(of[k], k)
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in results("op7_weighted_near_dup")[1]} == {k: (first[of[k]], size[of[k]]) for k in ids}


def test_op9_lines(results, texts):
    ids = sorted(texts)
    want = dict(zip(ids, brute_lines([(k, texts[k]) for k in ids])))
    assert {r["doc_id"]: r["text"] or "" for r in results("op9_line_templates")[1]} == want
