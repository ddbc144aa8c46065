"""Whitening against a plain eigendecomposition of exact sums."""

from fractions import Fraction

import numpy as np
import pytest
from goldseam.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, component string"


def table(spark, vectors, parts=3):
    rows = [(i, v, 1, "x", 5, "c") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors, count):
    """deviation, whitened (without sign) and explained by exact sums and numpy's solver."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return deviation, centred @ axes / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 40])
def test_components_of_random_covariances(size):
    random = np.random.default_rng(size)
    a = random.standard_normal((size, size))
    m = a @ a.T
    values, axes = whitening.leading_components(m, size)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(axes.T @ axes - np.eye(size)).max() < 1e-12
    assert np.abs(m @ axes - axes * values).max() < 1e-11 * values[0]


def test_components_of_hard_matrices():
    random = np.random.default_rng(1)
    q, _ = np.linalg.qr(random.standard_normal((30, 30)))
    for spectrum in (
        np.ones(30),  # one value thirty times
        np.r_[np.full(10, 5.0), np.full(20, 1.0)],
        np.r_[1 + 1e-13 * np.arange(15), 0.5 - 1e-10 * np.arange(15)],
        np.r_[1e6, np.full(29, 1e-3)],
    ):
        m = q * spectrum @ q.T
        m = (m + m.T) / 2
        values, axes = whitening.leading_components(m, 30)
        assert np.allclose(values, np.sort(spectrum)[::-1], rtol=1e-9, atol=1e-11 * spectrum.max())
        assert np.abs(axes.T @ axes - np.eye(30)).max() < 1e-11
        assert np.abs(m @ axes - axes * values).max() < 1e-11 * values[0]
    values, axes = whitening.leading_components(np.diag(np.r_[3.0, 3.0, 1.0, 0.0]), 4)
    assert values.tolist() == pytest.approx([3, 3, 1])
    assert np.abs(axes.T @ axes - np.eye(3)).max() < 1e-14
    low = np.outer(np.arange(1, 6), np.arange(1, 6)).astype(float)
    assert len(whitening.leading_components(low, 5)[0]) == 1
    assert len(whitening.leading_components(np.zeros((4, 4)), 4)[0]) == 0


def test_sturm_counts_count():
    random = np.random.default_rng(3)
    diagonal, off = random.standard_normal(12), random.standard_normal(11)
    off[4] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    shifts = np.linspace(-4, 4, 50)
    assert whitening.sturm_counts(diagonal, off, shifts).tolist() == [(values < s).sum() for s in shifts]


def test_whole_table(spark):
    random = np.random.default_rng(7)
    good = [(i, random.standard_normal(6).astype(np.float32).tolist()) for i in range(200)]
    good += [good[0], good[0], (None, good[1][1])]  # repeated rows, a null id
    bad = [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]
    bad += [(904, []), (905, [1.0, 2.0]), (906, [0.0] * 5 + [None])]
    got = whitening.whitened(table(spark, good + bad), 4)
    assert got.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    rows = got.collect()
    assert len(rows) == 4 * len(good) and {r.n for r in rows} == {len(good)}
    deviation, places, explained = brute([v for _, v in good], 4)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-10
    by_id = {}
    for r in rows:
        by_id.setdefault((r.vec_id, r.component), r)
    for c in range(4):
        mine = np.array([by_id[i, c + 1].whitened for i, _ in good])
        sign = np.sign(mine @ places[:, c])
        assert np.abs(mine * sign - places[:, c]).max() < 1e-9
        assert by_id[0, c + 1].explained == pytest.approx(explained[c], rel=1e-12)
    assert [by_id[i, 1].deviation for i, _ in good] == deviation


def test_few_dimensions_and_none(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(empty).count() == 0
    assert whitening.whitened(empty).columns[0] == "vec_id"
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])])).count() == 0  # one vector has no spread
    assert whitening.whitened(table(spark, [(i, [0.5, 0.25]) for i in range(9)])).count() == 0
    flat = whitening.whitened(table(spark, [(i, [float(i), 3.0]) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and {round(r.explained, 12) for r in flat} == {1.0}
    assert sorted(round(abs(r.whitened) ** 2, 9) for r in flat) == [0, 0.5, 0.5, 2, 2]


def test_far_values(spark):
    far = [(i, [float(2.0**40 * (i % 7)), float(i)]) for i in range(20)]
    got = whitening.whitened(table(spark, far)).collect()
    deviation, _, _ = brute([v for _, v in far], 2)
    want = {i: d if d < 2**63 else None for (i, _), d in zip(far, deviation, strict=True)}
    assert {r.vec_id: r.deviation for r in got} == want


def test_registered_query_on_the_given_table(spark):
    from goldseam.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op11_whitening"](spark, folder).collect()
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, places, explained = brute([r.embedding for r in vectors], 32)
    assert len(rows) == 32 * len(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert [by[v.vec_id, 1].deviation for v in vectors] == deviation
    for c in range(32):
        mine = np.array([by[v.vec_id, c + 1].whitened for v in vectors])
        assert np.abs(np.abs(mine) - np.abs(places[:, c])).max() < 1e-8
        assert by[vectors[0].vec_id, c + 1].explained == pytest.approx(explained[c], rel=1e-10)
    assert max(r.identity_error for r in rows) < 1e-9
