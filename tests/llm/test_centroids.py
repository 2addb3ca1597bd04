"""Centroid clustering against brute force, on ties, hot vectors and rows that are left out."""

import hashlib
import math

import numpy as np
import pytest

from modelshift.llm.centroids import Centroids, cluster_vectors, largest_component
from modelshift.llm.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SCHEMA = "vec_id long, embedding array<double>, cluster int, id string, v int, distance int"


def brute(rows: list[tuple], dimensions: int, scale: int, clusters: int, rounds: int) -> list[tuple]:
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions
            and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (
        r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, at) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    return sorted(
        ((i, c, d, sum(x[2] for x in out if x[1] == c), sum(x[2] for x in out),
          hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out),
        key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "z", 2, 3) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("spread", [0.05, 1.0, 40.0])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(int(spread * 100))
    rows = [(i, (rng.normal(0, spread, 6) + 3 * spread * (i % 5)).tolist()) for i in range(400)]
    rows += [(1000 + i, [spread] * 6) for i in range(300)]  # a third is one vector
    got = sorted(map(tuple, cluster_vectors(frame(spark, rows), dimensions=6, clusters=9).collect()), key=str)
    assert got == brute(rows, 6, 64, 9, 3)


def test_rows_that_are_left_out_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [0.5, 0.5]), (3, None),
            (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, -inf]),
            (9, [-0.01, 0.01]), (10, [0.5, 0.5]), (11, [1.0, 2.0, 3.0])]
    for clusters in (1, 2, 3, 20):
        got = cluster_vectors(frame(spark, rows), dimensions=2, clusters=clusters).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 2, 64, clusters, 3)
    for none in (rows[4:9], []):
        assert cluster_vectors(frame(spark, none), dimensions=2).count() == 0


def test_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(50)]  # two places, so most centroids get nothing
    got = cluster_vectors(frame(spark, rows), dimensions=2, clusters=8, rounds=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 2, 64, 8, 2)


def test_search_is_exact_and_passes_centroids_over():
    rng = np.random.default_rng(1)
    for size in (3, 50, 1 << 24):
        size = min(size, largest_component(8))
        rows = rng.integers(-size, size + 1, (40, 8))
        vectors = np.concatenate([rng.integers(-size, size + 1, (500, 8)), rows])
        number, distance, computed = Centroids(rows).nearest(vectors)
        every = ((vectors[:, None, :] - rows[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
        assert computed < every.size
    middle = Centroids(np.array([[0, 4], [4, 0], [2, 2], [2, 2]]))
    assert middle.nearest(np.array([[2, 2], [0, 0], [4, 4]]))[0].tolist() == [2, 2, 2]


def test_components_beyond_the_range_are_an_error(spark):
    with pytest.raises(Exception, match="over 536870912"):
        cluster_vectors(frame(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])]), dimensions=2).collect()


def test_query_equals_its_sql(spark, sf_dir):
    got = QUERIES["op13_centroids"](spark, sf_dir).toArrow()
    want = connect(sf_dir).sql(ORACLE["op13_centroids"]).to_arrow_table()
    assert len(got) > 0 and compare(got, want) == []
