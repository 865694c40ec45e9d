"""Quality verdicts from an isolation forest over rule statistics.

Every text is reduced to a row of counts.  Trees split the box of a bounded sample of
good rows at random; a row far from good ones leaves the box after few splits, so its
mean path is short.  The score that separates good from bad is read off the labelled
rows: the threshold with the most bad rows above it that keeps the loss of good rows
within ``MOST_LOST``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_texts, prepare

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_capitals", "n_exclaims", "n_digits", "n_stops"]
#: Repeated lines and words have a base rule of their own and occur in good texts too, as digits do.
FEATURES = ["words_log", "word_length", "symbols", "capitals", "exclaims", "stops"]

#: The forest: trees, rows per tree (a bound on what is gathered: TREES * ROWS), and splits on a path.
TREES, ROWS, DEPTH = 100, 256, 8
#: Part of the good labelled rows that the threshold may cost.
MOST_LOST = 0.003
BINS = 2000


def without(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


def rule_counts(text: str) -> tuple[int, ...]:
    """The counts BASE and MORE of one text."""
    data = text.encode()
    words = data.split()
    n_words = len(words)
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        mark = bytearray(n_words)
        for i, w in enumerate(windows):
            if found[w] > 1:
                mark[i : i + 3] = b"\1\1\1"
        repeated = sum(mark)
    return (
        n_words, len(text) - without(data, SPACE), without(data, SYMBOLS), len(full) - len(set(full)), repeated,
        len(full), without(data, CAPITALS), data.count(b"!"), without(data, b"0123456789"), without(data, b".,;:?"),
    )


def rule_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the ten counts; a null text has none."""
    keep = keep if keep is not None else [c for c in df.columns if c != text]

    def function(texts: list[str]) -> list:
        return [np.array(x, dtype=np.int64) for x in zip(*map(rule_counts, texts))]

    return map_texts(df, text, keep, [T.StructField(c, T.LongType()) for c in BASE + MORE], function)


def features(n: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each row of counts."""
    words, chars = np.maximum(n["n_words"], 1), np.maximum(n["word_chars"], 1)
    columns = [
        np.log1p(n["n_words"]), np.log(chars / words), np.log1p(100 * n["n_symbols"] / chars),
        n["n_capitals"] / chars, n["n_exclaims"] / words, n["n_stops"] / words,
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


def grow(sample: np.ndarray, widen: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as arrays by node (children of i: 2i+1, 2i+2): feature (-1 at a leaf), split, path length."""
    rng = np.random.default_rng(seed)
    size = 2 ** (DEPTH + 1) - 1
    feature, split, path = np.full(size, -1), np.zeros(size), np.zeros(size)
    low, high = sample.min(axis=0) - widen, sample.max(axis=0) + widen
    todo = [(0, sample, low, high, 0)]
    while todo:
        i, rows, a, b, depth = todo.pop()
        wide = np.flatnonzero(b > a)
        if depth == DEPTH or len(rows) <= 1 or not len(wide):
            path[i] = depth + average_path(np.array([len(rows)]))[0]
            continue
        f = rng.choice(wide)
        s = rng.uniform(a[f], b[f])
        feature[i], split[i] = f, s
        left = rows[:, f] <= s
        up, down = b.copy(), a.copy()
        up[f] = down[f] = s
        # Inside, the box shrinks to the rows, as in an isolation forest; the root's is the widened one.
        todo.append((2 * i + 1, rows[left], *_box(rows[left], a, up, widen, f), depth + 1))
        todo.append((2 * i + 2, rows[~left], *_box(rows[~left], down, b, widen, f), depth + 1))
    return feature, split, path


def _box(rows: np.ndarray, a: np.ndarray, b: np.ndarray, widen: np.ndarray, f: int):
    if not len(rows):
        return a, b
    return np.maximum(a, rows.min(axis=0) - widen), np.minimum(b, rows.max(axis=0) + widen)


def anomaly(x: np.ndarray, forest: list, rows: int = ROWS) -> np.ndarray:
    """Scores between 0 and 1; above a half means shorter paths than average."""
    total = np.zeros(len(x))
    each = np.arange(len(x))
    for feature, split, path in forest:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            inner = f >= 0
            at = np.where(inner, 2 * at + 1 + (x[each, np.maximum(f, 0)] > split[at]), at)
        total += path[at]
    return 2.0 ** (-total / len(forest) / max(average_path(np.array([rows]))[0], 1.0))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_forest(stats: DataFrame, good: DataFrame) -> list:
    """Trees over a bounded sample (TREES * ROWS rows at most) of the good rows' counts."""
    columns = BASE + MORE
    n = good.count()
    if n == 0:
        return []
    # About twice as many rows by hash, of them the first by another hash: repeated rows don't exceed the bound.
    part, by = min(1.0, 2 * TREES * ROWS / n), [c for c in good.columns if c not in columns and c != "good"]
    drawn = good.where(F.pmod(F.xxhash64(*by, *columns, F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy(F.xxhash64(*by, *columns, F.lit(8))).limit(TREES * ROWS)
    got = drawn.select(columns).toArrow()
    x = features({c: got.column(c).to_numpy() for c in columns})
    x = x[np.lexsort(x.T)]
    if not len(x):
        return []
    # Every split range is wider than the good rows by a quarter of their deviation, so that values no
    # good row has can be split off; a feature that never varies gets a little width too.
    widen = np.maximum(x.std(axis=0) * 0.25, 0.01)
    rng = np.random.default_rng(17)
    return [grow(x[rng.choice(len(x), min(ROWS, len(x)), replace=False)], widen, seed) for seed in range(TREES)]


def with_anomaly(stats: DataFrame, forest: list) -> DataFrame:
    """All columns and ``anomaly`` (0 for each row where there is no forest)."""
    prepare(stats.sparkSession)
    if not forest:
        return stats.withColumn("anomaly", F.lit(0.0))
    schema = T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())])

    def run(batches):
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in BASE + MORE})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly(x, forest))], names=schema.names)

    return stats.mapInArrow(run, schema)


def calibrated(scored: DataFrame) -> float:
    """Threshold from rows with ``good`` (boolean) and ``anomaly``; 2.0 (nothing is dropped) if a kind is missing."""
    bins = scored.groupBy("good", F.floor(F.col("anomaly") * BINS).alias("bin")).count().collect()
    counts = {k: np.zeros(BINS + 2) for k in (True, False)}
    for r in bins:
        counts[r["good"]][r["bin"]] += r["count"]
    if not counts[True].sum() or not counts[False].sum():
        return 2.0
    lost, caught = (counts[k][::-1].cumsum()[::-1] / counts[k].sum() for k in (True, False))
    fine = np.flatnonzero(lost <= MOST_LOST)
    # Of the thresholds that catch most, the one in the middle.
    best = fine[caught[fine] >= caught[fine].max() - 1e-9]
    return float(best[len(best) // 2]) / BINS if caught[fine].max() > 0 else 2.0


def quality_verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``key``, the counts, ``base_failed``, ``anomaly`` and ``kept`` for every row of ``docs``.

    ``labels`` has ``key`` and ``label`` (1 good, 0 bad); a key labelled both ways is bad,
    null labels and keys are passed over.  A null text has no words and so fails the base
    rules.  Rows that fail them take no part in fitting.  Without good labels all rows that
    pass stand for good ones; without labels of both kinds the forest drops nothing.
    Repeated rows get equal results.  An empty table gives an empty result.
    """
    stats = cut(rule_statistics(docs.select(key, text), text, [key]).withColumn("base_failed", base_failed()), "rules")
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.min(label) == 1).alias("good"))
    labelled = cut(stats.where(~F.col("base_failed")).join(named, F.col(key) == F.col("__key")).drop("__key"), "labelled")
    good = labelled.where("good")
    forest = fit_forest(stats, good if good.limit(1).count() else stats.where(~F.col("base_failed")))
    threshold = calibrated(with_anomaly(labelled, forest))
    return with_anomaly(stats, forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
