"""Whitening against exact sums and a a plain singular value decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tallyfold.llm import entries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """Number and sums of the distinct vectors, their variances and components (by SVD of the exactly centred vectors)."""
    fit = sorted(set(map(tuple, vectors)))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    scaled = np.array([[v[k] * n - sums[k] for k in range(d)] for v in fit], dtype=object)
    centred = np.array([[float(Fraction(int(a), n)) for a in row] for row in scaled])
    _, singular, axes = np.linalg.svd(centred, full_matrices=False)
    return n, sums, singular**2 / n, axes


def check(rows, vectors, tolerance=1e-7):
    """rows: collected result by id; vectors: id -> floats."""
    whole = {k: [math.floor(float(c) * 64) + 1000000 for c in v] for k, v in vectors.items()}
    n, sums, values, axes = brute(whole.values())
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(whole)
    signs = {}
    for k, x in whole.items():
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for c, r in by[k].items():
            assert r["n"] == n and r["deviation"] == (exact if exact < 2**63 else None)
            want = centred @ axes[c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-3:
                signs.setdefault(c, math.copysign(1, r["whitened"] * want))
            assert math.isclose(r["whitened"], want * signs.get(c, 1), rel_tol=tolerance, abs_tol=1e-2 if c not in signs else tolerance), (k, c)
            assert math.isclose(r["explained"], values[c - 1] / values.sum(), rel_tol=1e-6) and r["identity_error"] < 1e-6
    return by


def test_op12(spark):
    df = entries.queries()["op12_shifted_cholesky"](spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    by = check(df.collect(), vectors)
    assert all(sorted(c) == list(range(1, 17)) for c in by.values())


def test_ill_conditioned_and_repeated(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6)) @ np.diag([1e6, 1e4, 100, 10, 1, 0.3]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    vectors = {k: base[k % 400].tolist() for k in range(900)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(5)
    by = check(whitening.whitening(df).collect(), vectors, 1e-5)
    assert by[0][1]["n"] == 400 and len(by[0]) == 6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [1.0, 2.0, -0.3], 2: [0.5, 2.5, 9.0], 3: [0.5, 2.5, 9.0], 4: [-3.0, 0.0, 1.0], 5: [4.0, 4.0, 4.0], 6: [0.0, 7.0, 0.0]}
    odd = {10: None, 11: [1.0, None, 2.0], 12: [nan, 1.0, 2.0], 13: [inf, 1.0, 2.0], 14: [], 15: [1.0], 16: [1e300, 0.0, 0.0]}
    df = spark.createDataFrame([(k, v, "a") for k, v in (good | odd).items()], "vec_id long, embedding array<double>, __x string")
    rows = whitening.whitening(df, keep=["vec_id"]).collect()
    check(rows, good)
    assert whitening.whitening(df, keep=["vec_id", "__x"]).columns[:2] == ["vec_id", "__x"]
    assert whitening.whitening(df.where("vec_id > 9 AND vec_id < 14"), keep=["vec_id"]).count() == 0
    assert whitening.whitening(df.where("false"), keep=["vec_id"]).count() == 0
    assert whitening.whitening(df.where("vec_id IN (2, 3)"), keep=["vec_id"]).count() == 0  # one distinct vector has no variance
    with pytest.raises(ValueError):
        whitening.whitening(df.withColumn("N", df.vec_id))


def test_fewer_dimensions_than_entries(spark):
    """Vectors in a plane of a space: two components, the same as in the plane."""
    rng = np.random.default_rng(3)
    flat = rng.integers(-500, 500, size=(200, 2))
    vectors = {k: [a / 64, b / 64, (a + b) / 64, (2 * a - b) / 64, 5.0] for k, (a, b) in enumerate(flat.tolist())}
    rows = whitening.whitening(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()
    by = check(rows, vectors)
    assert all(sorted(c) == [1, 2] for c in by.values())


def test_exact_beyond_doubles():
    centre = whitening.Centre(3, [10**15 + 1, -5])
    x = np.array([[4 * 10**14, 7], [0, -10**15]])
    want = [sum((3 * a - s) ** 2 for a, s in zip(row, (10**15 + 1, -5))) for row in x.tolist()]
    assert centre.deviations(x) == [w if w < 2**63 else None for w in want]
    small = np.array([[333333333333334, -2]])
    assert centre.deviations(small) == [(3 * 333333333333334 - 10**15 - 1) ** 2 + 1]
