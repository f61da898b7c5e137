import math

import numpy as np
import pytest

from corpuskiln.llm.whitening import (
    Whitening,
    integer_vectors,
    one_sided_jacobi,
    pivoted_cholesky,
    rounds_of_pairs,
    whiten,
)

TYPE = "vec_id bigint, embedding array<float>, x string, component int, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, "n") for i, v in rows], TYPE)


def brute(rows, k=16):
    """Covariance over distinct integer vectors and its eigenvectors by the library."""
    x = {}
    for at, (_, v) in enumerate(rows):
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            x[at] = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
    fit = [*{tuple(v) for v in x.values()}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    rank = int((e > 1e-9 * max(e[0], 1e-300)).sum())
    k = min(k, rank)
    out = {}
    for at, v in x.items():
        off = [n * c - s for c, s in zip(v, sums, strict=True)]
        out[at] = (sum(c * c for c in off), np.array([c / n for c in off]) @ q[:, :k] / np.sqrt(e[:k]))
    return n, e[:k] / e.sum(), out


def check(spark, rows, k=16):
    n, shares, expected = brute(rows, k)
    found = whiten(table(spark, rows).repartition(3), components=k).toPandas()
    ids = [rows[at][0] for at in expected]
    assert sorted(found["vec_id"]) == sorted(i for i in ids for _ in shares)
    assert set(found["n"]) == {n} and found["identity_error"].nunique() == 1
    assert found["identity_error"].max() < 1e-9
    wide = found.pivot(index="vec_id", columns="component", values="whitened")
    assert list(wide.columns) == list(range(1, len(shares) + 1))
    want = np.array([expected[at][1] for at in sorted(expected, key=lambda at: rows[at][0])])
    got = wide.sort_index().to_numpy()
    sign = np.sign((want * got).sum(0))
    np.testing.assert_allclose(got * sign, want, rtol=0, atol=1e-7)
    by_id = found.drop_duplicates("vec_id").set_index("vec_id")["deviation"]
    assert by_id.to_dict() == {rows[at][0]: expected[at][0] for at in expected}
    np.testing.assert_allclose(found.drop_duplicates("component")["explained"], shares, rtol=1e-9)
    return found


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(0.3, 2, d)).astype(np.float32)


def test_equals_the_library_with_copies_and_bad_rows(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1, 300, 24))]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    rows += [(2000, None), (2001, [float("nan")] * 24), (2002, [1.0] * 23 + [None]), (2003, [float("inf")] + [0.0] * 23)]
    check(spark, rows)


def test_fewer_components_than_asked_for(spark):
    base = vectors(2, 60, 3)
    flat = [(i, [*v.tolist(), 0.5]) for i, v in enumerate(base)]  # one constant dimension
    assert check(spark, flat)["component"].max() == 3
    few = [(i, v.tolist()) for i, v in enumerate(vectors(3, 5, 12))]  # rank 4
    assert check(spark, few)["component"].max() == 4


def test_large_entries_stay_exact(spark):
    scale = np.float32(1e9)
    rows = [(i, (v * scale).tolist()) for i, v in enumerate(vectors(4, 40, 4))]
    n, _, expected = brute(rows)
    found = whiten(table(spark, rows)).toPandas().drop_duplicates("vec_id").set_index("vec_id")
    assert {i: int(d) for i, d in found["deviation_exact"].items()} == {rows[at][0]: v[0] for at, v in expected.items()}
    assert found["identity_error"].max() < 1e-9
    huge = whiten(table(spark, [(0, [1e38, 0.0]), (1, [-1e38, 1.0]), (2, [0.0, 5.0])])).toPandas()
    assert huge["deviation"].isna().tolist() == [i != 2 for i in huge["vec_id"]]
    assert len(huge) and huge["deviation_exact"].notna().sum() == 1


def test_ids_lengths_and_nothing_to_fit(spark):
    rows = [(None, [1.0, 2.0]), (None, [2.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [1.0]), (7, [])]
    found = whiten(table(spark, rows)).toPandas()
    assert len(found) == 4 * 2 and found["vec_id"].isna().sum() == 4
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        result = whiten(table(spark, none))
        assert result.count() == 0
        assert result.columns[:7] == "vec_id component n deviation whitened explained identity_error".split()


def test_integer_vectors(spark):
    got = integer_vectors(table(spark, [(1, [0.0, -0.01, 1.5])])).first()["x"]
    assert got == [1_000_000, 999_999, 1_000_096]


@pytest.mark.parametrize("d, rank", [(1, 1), (6, 6), (9, 4), (5, 0)])
def test_factor_and_rotations(d, rank):
    half = np.random.default_rng(d).normal(size=(d, rank)) * np.logspace(0, -4, rank)
    matrix = half @ half.T
    factor = pivoted_cholesky(matrix)
    np.testing.assert_allclose(factor @ factor.T, matrix, atol=1e-12)
    values, columns = one_sided_jacobi(factor)
    assert len(values) == rank
    np.testing.assert_allclose((columns * values) @ columns.T, matrix, atol=1e-12)
    np.testing.assert_allclose(columns.T @ columns, np.eye(rank), atol=1e-10)


def test_small_eigenvalues_keep_relative_precision():
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))
    factor = q * np.logspace(0, -10, 6)
    values, _ = one_sided_jacobi(factor)
    np.testing.assert_allclose(values, np.logspace(0, -20, 6), rtol=1e-9)


def test_rounds_meet_every_pair_once():
    for k in (1, 2, 5, 8):
        met = [frozenset(p) for a, b in rounds_of_pairs(k) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(met) == len(set(met)) == k * (k - 1) // 2


def test_deviation_beyond_64_bits():
    model = Whitening(10**6, np.array([0, 0]), [1, -1], np.eye(2), np.ones(2), 2.0)
    x = np.array([[10**9, 0], [3, 4]])
    assert model.deviation(x) == [(10**15 - 1) ** 2 + 1, (3 * 10**6 - 1) ** 2 + (4 * 10**6 + 1) ** 2]
