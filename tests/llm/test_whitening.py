"""Whitening and its eigenvectors against plain linear algebra on all rows."""

import math

import numpy as np
import pytest

from quire.llm import whitening
from quire.llm.eigen import WIDE, eigenpairs
from quire.llm.queries import op11_whitening

VECTORS = "vec_id long, embedding array<float>, label int, whitened string, deviation string, x int, slot int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b", 2, 3) for i, v in rows], VECTORS)


def symmetric(rng, values):
    size = len(values)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0].astype(WIDE)
    for _ in range(4):
        turn = turn + turn @ (np.eye(size, dtype=WIDE) - turn.T @ turn) / 2
    own = (turn * values) @ turn.T
    return turn, (own + own.T) / 2


@pytest.mark.parametrize("spread", [
    lambda rng: rng.uniform(50, 110, 48),
    lambda rng: np.concatenate([rng.uniform(50, 110, 40), 80 + 1e-8 * np.arange(8)]),
    lambda rng: np.concatenate([rng.uniform(50, 110, 30), 80 + 1e-9 * np.arange(4), 90 + 1e-7 * np.arange(4), [100.0] * 3]),
    lambda rng: 1 + 1e-9 * np.arange(24),
    lambda rng: np.ones(16),
    lambda rng: np.concatenate([np.zeros(20), rng.uniform(1, 2, 12)]),
    lambda rng: 10.0 ** -np.arange(0, 9, 0.25),
    lambda rng: np.array([3.0]),
    lambda rng: np.zeros(3),
])
def test_eigenpairs_of_spread_close_and_equal_values(spread):
    rng = np.random.default_rng(4)
    values = np.sort(spread(rng))[::-1].astype(WIDE)
    turn, own = symmetric(rng, values)
    found, vectors = eigenpairs(own)
    size = max(float(np.abs(values).max()), 1e-300)
    unit = float(np.finfo(WIDE).eps)
    assert np.abs(found - values).max() <= 100 * unit * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 100 * unit
    assert np.abs(own @ vectors - vectors * found).max() <= 1000 * unit * size
    gaps = np.abs(np.diff(values))
    if len(values) > 1 and gaps.min() >= 1e-9:  # the vectors themselves are defined
        cosines = np.abs((turn * vectors).sum(axis=0))
        assert np.abs(1 - cosines).max() < 1e-14


def plain(rows):
    """Rows of (id, vector) that take part, by the definitions."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), [int(s) for s in listed.sum(axis=0)]
    own = listed - listed.mean(axis=0)
    covariance = own.T @ own / n
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:16]
    white = (x - np.array(sums) / n) @ found[:, order] / np.sqrt(values[order])
    deviations = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [i for i, _ in kept], n, deviations, white, values[order] / np.trace(covariance)


def some_rows(count, entries, seed):
    rng = np.random.default_rng(seed)
    own = rng.standard_normal((count, entries)) @ np.diag(np.linspace(1, 0.2, entries)) / 4
    rows = list(enumerate(own.astype(np.float32).tolist()))
    same = rows[7][1]
    rows += [(count + i, same) for i in range(count // 2)]  # one vector in a third of the rows
    return rows + [(9001, None), (9002, []), (9003, [None] * entries), (9004, [float("nan")] * entries), (9005, [1.0] * (entries - 1) + [float("inf")])]


def test_query_like_plain_algebra(spark, tmp_path):
    rows = some_rows(300, 20, 1)
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op11_whitening(spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes) | {"component": "int", "deviation": "bigint", "n": "bigint"} == dict(got.dtypes)
    ids, n, deviations, white, shares = plain(rows)
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert len(found) == len(ids) * 16 and {i for i, _ in found} == set(ids)
    signs = [np.sign(found[ids[0], k + 1].whitened * white[0, k]) for k in range(16)]
    for at, i in enumerate(ids):
        for k in range(16):
            row = found[i, k + 1]
            assert row.n == n and row.deviation == deviations[at] and row.identity_error < 1e-10
            assert abs(row.whitened * signs[k] - white[at, k]) < 1e-9 and abs(row.explained - shares[k]) < 1e-12


def test_whitening_awkward_tables(spark):
    nothing = vectors(spark, [])
    for df in (nothing, vectors(spark, [(1, None), (2, []), (3, [float("nan")])])):
        model = whitening.fit(df)
        assert model.count == 0 and whitening.whiten(df, model).collect() == []
    one = vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])
    model = whitening.fit(one)
    rows = whitening.whiten(one, model).collect()
    assert model.count == 1 and len(model.values) == 0
    assert [(r.vec_id, r.whitened, r.deviation, r.label, r.slot) for r in sorted(rows, key=lambda r: r.vec_id or 0)] == [
        (None, [], 0, 1, 3), (1, [], 0, 1, 3), (2, [], 0, 1, 3),
    ]
    # Two widths: the one of most rows; a direction without spread is no component.
    mixed = vectors(spark, [(i, [float(i), 1.0, 2.0]) for i in range(5)] + [(9, [1.0]), (10, [1e300, 1.0, 1.0])])
    model = whitening.fit(mixed)
    rows = whitening.whiten(mixed, model, whitened="w", deviation="d").collect()
    assert model.count == 5 and len(model.values) == 1 and {r.vec_id for r in rows} == set(range(5))
    assert {round(abs(r.w[0]), 9) for r in rows} == {0.0, round(1 / math.sqrt(2), 9), round(2 / math.sqrt(2), 9)}
    assert {r.whitened for r in rows} == {"a"}


def test_numbers_far_from_zero_and_large(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (200, 5))
    near = whitening.fit(spark.createDataFrame([(v,) for v in (base / 64.0).tolist()], "embedding array<double>"))
    far = whitening.fit(spark.createDataFrame([(v,) for v in (base / 64.0 + 2.0**30).tolist()], "embedding array<double>"))
    assert np.array_equal(near.values, far.values) and near.identity_error < 1e-12 and far.identity_error < 1e-12
    huge = spark.createDataFrame([(v,) for v in (base * 2.0**36).tolist()], "embedding array<double>")
    model = whitening.fit(huge)
    assert np.allclose(model.values / near.values, 2.0**84, rtol=1e-12)
    assert {r.deviation for r in whitening.whiten(huge, model).collect()} == {None}
