"""Centroid clustering: against a scan of all centroids, its SQL, and awkward rows."""

import hashlib
import math

import numpy as np
import pytest

from locusframe.llm import kmeans, registry

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=40, rounds=5, seed=2, n=64):
    """Every vector against every centroid in Python's integers."""
    kept = [(i, tuple(math.floor(256 * x) for x in e)) for i, e in rows if e is not None and len(e) == n and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    points = [e for _, e in order[:k]]
    nearest = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(points))
    for _ in range(rounds):
        own = [nearest(e)[1] for _, e in kept]
        for j in range(len(points)):
            if mine := [e for (_, e), o in zip(kept, own, strict=True) if o == j]:
                points[j] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    last = [nearest(e) for _, e in kept]
    total = [sum(d for d, o in last if o == j) for j in range(len(points))]
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, o, d, total[o], sum(total), sha[o]) for (i, _), (d, o) in zip(kept, last, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_query_against_all_centroids_and_its_sql(spark, sf_dir):
    from tests.oracle import database, difference

    df = registry.queries()["op13_exponion_clusters"](spark, sf_dir)
    assert difference(df, database(sf_dir), registry.oracle_sql()["op13_exponion_clusters"]) is None
    assert got(df) == brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()])


def vector(*head):
    return [float(x) for x in head] + [0.0] * (64 - len(head))


def test_ties_copies_and_awkward_vectors(spark):
    rows = [(i, vector(i % 7, (i * i) % 5)) for i in range(200)]  # many ties and equal vectors
    rows += [(500, None), (501, vector(1)[:63]), (502, [None, *vector(1)[1:]]), (503, vector(float("nan"))), (504, vector(float("inf"))), (505, []), (None, vector(3, 3)), (7, vector(1)), (7, vector(1)), (506, vector(-0.001, -1e-30, 2.5))]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    assert got(kmeans.clustered(df)) == brute(rows)
    assert got(kmeans.clustered(df.selectExpr("vec_id", "embedding", "1 as cluster", "2 as V", "3 as upper"))) == brute(rows)
    few = df.where("vec_id < 5")
    assert got(kmeans.clustered(few)) == brute(rows[:5])
    assert kmeans.clustered(df.limit(0)).count() == 0 and kmeans.clustered(df.limit(0)).columns == COLUMNS
    one = spark.createDataFrame([(1, vector(5), 0)] * 50, SCHEMA)
    assert got(kmeans.clustered(one)) == brute([(1, vector(5))] * 50)


def test_large_components_are_exact_up_to_the_bound(spark):
    rows = [(i, vector((-1) ** i * 400_000.5 - i, i * 1000)) for i in range(90)]
    assert got(kmeans.clustered(spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA))) == brute([(i, np.array(e, dtype=np.float32).astype(float).tolist()) for i, e in rows])
    huge = spark.createDataFrame([(1, vector(3e38), 0), (2, vector(-3e38), 0), (3, vector(0), 0)], SCHEMA)
    assert [r.distance for r in kmeans.clustered(huge).collect()] == [0, 0, 0]


@pytest.mark.parametrize("spread", [3, 60, 2000])
def test_search_finds_the_nearest_from_any_bounds_and_scans_less(spread):
    rng = np.random.default_rng(spread)
    middle = rng.integers(-spread, spread, (40, 8)) * 4
    x = (middle[rng.integers(0, 40, 3000)] + rng.integers(-2, 3, (3000, 8))).astype(np.int64)
    points = np.concatenate([middle[:30], middle[:10]]).astype(np.int64)  # some centroids twice
    want = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    centroids = kmeans.Centroids(points)
    own, upper, lower, _ = kmeans.searched(x, rng.integers(0, 40, 3000), np.full(3000, np.inf), np.zeros(3000), centroids)
    assert (own == want.argmin(axis=1)).all()
    rank = np.sort(want, axis=1)
    assert (upper >= np.sqrt(rank[:, 0])).all() and (lower <= np.sqrt(rank[:, 1])).all()
    moved = rng.integers(-1, 2, points.shape)
    far = np.sqrt((moved**2).sum(axis=1))
    again = kmeans.Centroids(points + moved)
    own, _, _, taken = kmeans.searched(x, own, upper + far[own], np.maximum(lower - far.max(), 0), again)
    assert (own == ((x[:, None] - again.points[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert taken < 0.8 * 3000 * 40
