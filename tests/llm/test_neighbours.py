"""Approximate neighbours against a comparison with all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import neighbours
from quire.llm.partitions import balanced, learn, split
from quire.llm.queries import op12_neighbours

VECTORS = "vec_id long, embedding array<float>, x int, key string, part int, at int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2, 3) for i, v in rows], VECTORS)


def brute(rows, count=20, every=20):
    """All others of each query, ranked by product and id; rows by their place."""
    width = max((len(v) for _, v in rows if v), default=0)
    own = [(at, i, np.float32(v).astype(np.float64)) for at, (i, v) in enumerate(rows) if v and len(v) == width
           and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    found = {}
    for at, i, v in own:
        if i is not None and i % every == 0:
            scored = sorted((-float((v * w).sum()), -(2**63) if j is None else j) for other, j, w in own if other != at)
            found.setdefault(i, []).append([(j, -s) for s, j in scored[:count]])
    return found


def results(df):
    found = {}
    for row in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(row.query_id, []).append((-(2**63) if row.vec_id is None else row.vec_id, row.score))
    return found


def same(got, want):
    assert set(got) == set(want)
    for i, hits in got.items():
        assert [j for j, _ in hits] == [j for j, _ in want[i][0]], i
        assert np.allclose([s for _, s in hits], [s for _, s in want[i][0]], rtol=1e-12, atol=1e-12)


def recalled(got, want):
    return np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i][0]}) / len(want[i][0]) for i in want])


def test_few_vectors_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    own = rng.integers(-2, 3, (180, 4)).astype(np.float32)  # many ties and copies
    rows = list(enumerate(own.tolist()))
    rows += [(1000, None), (1020, []), (1040, [0.0] * 4), (1060, [1.0, None, 0.0, 0.0]), (1080, [float("nan")] * 4), (1100, [1.0]), (None, [2.0, 2.0, 2.0, 2.0])]
    got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    same(results(got), brute(rows))
    few = rows[:6]
    same(results(neighbours.nearest(vectors(spark, few), F.col("vec_id") % 20 == 0)), brute(few))
    assert neighbours.nearest(vectors(spark, []), F.lit(True)).collect() == []
    assert neighbours.nearest(vectors(spark, [(0, [1.0, 2.0])]), F.lit(True)).collect() == []


def test_rows_that_share_an_id_leave_out_themselves(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (40, [1.0, 0.0])]
    got = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    lists = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)
    assert lists == sorted([
        (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 40, 1.0), (0, 4, 0, 0.0),
        (0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 0, 0.0), (0, 4, 40, 0.0),
        (40, 1, 0, 1.0), (40, 2, 1, 1.0), (40, 3, 1, 1.0), (40, 4, 0, 0.0),
    ])


def test_balanced_and_split():
    rng = np.random.default_rng(1)
    labels = balanced(rng.standard_normal((1000, 7)) + np.arange(7), 150)
    assert np.bincount(labels, minlength=7).max() <= 150 and labels.min() >= 0
    centres = rng.standard_normal((8, 16))
    of = np.repeat(np.arange(8), 100)
    rows = centres[of] + 0.05 * rng.standard_normal((800, 16))
    scores = rows @ rows.T
    np.fill_diagonal(scores, -np.inf)
    near = np.argsort(-scores, axis=1)[:, :10]
    labels = split(rows, near, 8)
    assert np.bincount(labels, minlength=8).max() <= 105
    assert (labels[near] == labels[:, None]).mean() > 0.8
    router = learn(rows, near, 8, 0.95)
    seen = [np.isin(router.homes(rows[own]), visit).mean() for own, visit in zip(near, router.visits(rows))]
    assert np.mean(seen) > 0.93 and np.mean([len(visit) for visit in router.visits(rows)]) < 4


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths", "copies"])
def test_recall(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # partitions and visitors are cut
    rng = np.random.default_rng(5)
    own = rng.standard_normal((3000, 24))
    if kind == "clusters":
        own = rng.standard_normal((30, 24))[rng.integers(0, 30, 3000)] + 0.3 * own
    if kind == "lengths":
        own *= rng.lognormal(0, 0.5, (3000, 1))
    if kind == "copies":
        own[1000:2000] = own[0]
        own[2000:2600] = own[1] + 0.001 * own[2000:2600]  # a third are one vector, a fifth nearly one
    rows = list(enumerate(own.astype(np.float32).tolist()))
    got, want = results(neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0)), brute(rows)
    assert set(got) == set(want) and all(len(hits) == 20 for hits in got.values())
    assert recalled(got, want) >= 0.93
    for i, hits in got.items():  # what is found is scored and ordered exactly
        assert hits == sorted(hits, key=lambda hit: (-hit[1], hit[0])) and i not in [j for j, _ in hits]
        assert np.allclose([s for _, s in hits], [float(np.float32(own[i]).astype(float) @ np.float32(own[j]).astype(float)) for j, _ in hits], rtol=1e-11)


def test_query_over_its_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = results(op12_neighbours(spark, folder)), brute(rows)
    assert set(got) == set(want) and recalled(got, want) >= 0.9
