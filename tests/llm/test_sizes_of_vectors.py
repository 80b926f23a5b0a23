"""Nearest neighbours where vectors differ by many orders of magnitude, and vectors that are equally far."""

import numpy as np
import pytest

from quarry.llm import ann


def exact(ids, x, query, k=10):
    """The k nearest by distances with scaled squares, ties to the smaller id."""
    with np.errstate(over="ignore"):
        apart = np.abs(x - x[ids.index(query)])
    most = apart.max(axis=1)
    d = most * np.sqrt(((apart / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))
    order = sorted((float(d[i]), ids[i]) for i in range(len(ids)) if ids[i] != query)
    return order[:k]


def recall(spark, rows):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    found = {}
    for r in ann.op2_nn_descent(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids if i % 100 == 0}
    hits = total = 0
    for query, got in found.items():
        got.sort()
        want = exact(ids, x, query, min(10, len(ids) - 1))
        assert [rank for rank, _, _ in got] == list(range(1, len(want) + 1))
        # a hit is one as near as the last wanted, since double precision can't tell some apart
        far = want[-1][0] * (1 + 1e-12)
        hits, total = hits + sum(score <= far for _, _, score in got), total + len(want)
    return hits / total


@pytest.mark.parametrize("huge", [1e60, 1e300])
def test_one_huge_vector(spark, huge):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(700)] + [(5000, [huge] + [0.0] * 15)]
    assert recall(spark, rows) >= 0.95


def test_several_sizes(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=8) * scale).tolist()) for base, scale in ((0, 1e-250), (1000, 1.0), (2000, 1e200)) for k in range(base, base + 150)] + [(3000, [1e-305] * 8), (3100, [0.0] * 7 + [3e300])]
    assert recall(spark, rows) >= 0.95
    few = [(0, [1.0, 0.0]), (1, [1e100, 0.0]), (2, [1e-100, 0.0]), (100, [1e200, 1e200]), (7, [1e-100, 1e-100])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.op2_nn_descent(spark.createDataFrame(few, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 7), (0, 3, 1), (0, 4, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 7)]


def test_equal_distances_go_to_smaller_ids(spark):
    rows = [(100, [1.0] + [0.0] * 12)] + [(k, [2.0 if j == k % 12 + 1 else 1.0 * (j == 0) for j in range(13)]) for k in range(1, 13)]
    got = [(r["vec_id"], r["score"]) for r in ann.op2_nn_descent(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(k, 2.0) for k in range(1, 11)]


def test_bands():
    assert ann.bands([]) == [] and ann.bands([3]) == [3] and ann.bands([-5, 0, 40, 100, 130]) == [-5, 100]
    chained = ann.bands(list(range(0, 250, 50)))  # no gap, but too wide for one
    assert len(chained) > 1 and chained[0] == 0
