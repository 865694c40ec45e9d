"""The registered query op5_edit_windows against exact distances of all windows."""

import numpy as np
import pytest

from tallyfold.llm import edit_windows, entries
from tallyfold.llm.shingles import folded, word_hashes

SF = "/root/testdata/sf0.001"


def plain(texts):
    values, separators = folded()
    words, counts = word_hashes([(x or "").casefold().encode() for x in texts], values, separators)
    return np.split(words, np.cumsum(counts)[:-1])


def test_op5_against_all_windows(spark):
    """Nothing is found that is not there, with its exact edits; of what is there at least nine in ten are found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    texts, asked = plain([r["text"] for r in docs]), plain([r["text"] for r in items])
    true = {}
    for item, w in zip(items, asked):
        m = len(w)
        for doc, t in zip(docs, texts):
            if np.isin(t, w).sum() < m - edit_windows.edits_allowed(m) or len(t) < 1:  # fewer words in common than any window needs
                continue
            gap = edit_windows.edits_allowed(m)
            padded = np.r_[np.zeros(gap, np.uint64), t, np.zeros(max(gap, m - len(t)), np.uint64)]
            windows = np.lib.stride_tricks.sliding_window_view(padded, m)
            far = int(edit_windows.edit_distances(windows, np.tile(w, (len(windows), 1))).min())
            if far <= edit_windows.edits_allowed(m):
                true[doc["doc_id"], item["item_id"]] = far
    rows = entries.queries()["op5_edit_windows"](spark, SF).collect()
    got = {(r["doc_id"], i): e for r in rows for i, e in zip(r["item_ids"], r["edits"])}
    assert true and got.keys() <= true.keys() and all(e >= true[k] for k, e in got.items())
    assert len(got) >= 0.9 * len(true)
    assert all(r["contaminated"] == bool(r["item_ids"]) for r in rows) and len(rows) == len(docs)


@pytest.mark.parametrize("most", [1, 7])
def test_blocks_of_few_items_find_the_same(spark, monkeypatch, most):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(map(str, edit_windows.found_items(docs, items).select("doc_id", "found").collect()))
    monkeypatch.setattr(edit_windows, "BLOCK_ITEMS", most)
    assert sorted(map(str, edit_windows.found_items(docs, items).select("doc_id", "found").collect())) == want
