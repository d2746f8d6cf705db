"""Clusters against plain k-means in Python integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from arggraph_spark.llm import centroids, oracles

SCHEMA = "vec_id long, embedding array<float>, label int, distance string, own int, moved boolean"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", 7, True) for i, v in rows], schema).repartition(3)


def plain(rows, k, rounds, size, scale=1024):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(scale * float(np.float32(x))) <= 1 << 27 for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    middle = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(middle)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                middle[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, o in found if o == j) for j in range(len(middle))}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(str((i, o, d, total[o], sum(total.values()), sha(middle[o]))) for i, d, o in found)


def result(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize(("n", "k", "groups", "spread"), [(300, 8, 3, 1.0), (200, 20, 5, 0.01), (150, 7, 1, 40.0)])
def test_equals_plain_k_means(spark, n, k, groups, spread):
    r = random.Random(n)
    rows = [(i, [r.choice([0, 1, -1]) + r.gauss(0, spread) for _ in range(4)]) for i in range(n)]
    got = centroids.clusters(frame(spark, rows), k=k, rounds=6, groups=groups, size=4)
    assert result(got) == plain(rows, k, 6, 4)


def test_odd_rows_ties_and_repeats(spark):
    good = [(i, [float(i % 3), float(i % 2)]) for i in range(40)]  # few places, so many ties
    odd = [(50, None), (51, []), (52, [1.0]), (53, [1.0, None]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (56, [1.0, 2.0, 3.0]), (57, [1e30, 0.0]), (None, [0.5, 0.5]), (None, None)]
    rows = good + odd + good[:10] + [(60, [-0.0004, 131071.0])]
    assert result(centroids.clusters(frame(spark, rows), k=5, rounds=4, groups=2, size=2)) == plain(rows, 5, 4, 2)


def test_one_vector_in_many_copies(spark):
    rows = [(i, [0.25, 0.5]) for i in range(60)]
    assert result(centroids.clusters(frame(spark, rows), k=3, rounds=2, groups=2, size=2)) == plain(rows, 3, 2, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0])]
    assert result(centroids.clusters(frame(spark, rows), k=8, rounds=3, size=2)) == plain(rows, 8, 3, 2)
    none = centroids.clusters(frame(spark, rows).limit(0), k=8, rounds=3, size=2)
    assert none.count() == 0
    assert none.dtypes == centroids.clusters(frame(spark, rows), k=1, rounds=1, size=2).dtypes


def test_large_components_stay_exact():
    r = np.random.default_rng(0)
    v, c = r.integers(-(1 << 27), 1 << 27, (5, 64)), r.integers(-(1 << 27), 1 << 27, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert centroids.squared(v, c).tolist() == want


def test_bounds_pass_over_most_distances():
    """Once centroids move little, few vectors are looked at again."""
    r = np.random.default_rng(1)
    middle = r.integers(-9000, 9000, (12, 16))
    v = middle[r.integers(0, 12, 5000)] + r.integers(-20, 20, (5000, 16))
    groups = centroids.grouped(middle, 3)
    own, upper, lower = centroids.scan_all(v, middle, groups)
    after = middle + 1
    scanned = []
    before, centroids.squared = centroids.squared, lambda a, b: scanned.append(len(a)) or before(a, b)
    try:
        got = centroids.reassign(v, own, upper, lower, after, groups, np.sqrt(((after - middle) ** 2).sum(1)) * 1.001)
    finally:
        centroids.squared = before
    assert (got[0] == before(v, after).argmin(1)).all()
    assert sum(scanned) == 0


def test_sql(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(80)] + [(100, [0.0] * 3), (101, None)]
    df = frame(spark, rows)
    con = duckdb.connect()
    con.register("held", df.select("vec_id", "embedding").toArrow())
    con.execute("create view embeddings as select * from held")
    want = con.execute(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({oracles.clusters_sql(k=4, rounds=3, size=4)})").fetchall()
    assert result(centroids.clusters(df, k=4, rounds=3, groups=2, size=4)) == sorted(map(str, want))
