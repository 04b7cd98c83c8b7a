import hashlib
import math

import numpy as np
import pytest

from quernel.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, id string, x string, ids string, points string, cluster string"


def brute(rows, dim, k, rounds, scale):
    """The same clustering in Python integers, row by row."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) and math.isfinite(v * scale) for v in x):
            kept.append((vec_id, [math.floor(v * scale) for v in x], x))
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    rows = [v for _, v, _ in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, row)), c) for c, row in enumerate(rows))

    for _ in range(rounds):
        members = [[] for _ in rows]
        for _, v, _ in kept:
            members[nearest(v)[1]].append(v)
        rows = [[sum(column) // len(own) for column in zip(*own)] if own else row for row, own in zip(rows, members)]
    found = [(vec_id, *nearest(v)) for vec_id, v, _ in kept]
    sums = [sum(d for _, d, c in found if c == number) for number in range(len(rows))]
    long = lambda v: v if v < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in rows]
    return sorted(((i, c, long(d), long(sums[c]), long(sum(sums)), digest[c]) for i, d, c in found), key=repr)


def run(spark, rows, dim, k, rounds, scale):
    table = spark.createDataFrame([(i, x, 1, *"abcde") for i, x in rows], SCHEMA).repartition(3)
    found = centroids.cluster(table, "vec_id", "embedding", dim, k, rounds, "3:", scale)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def random_rows(count, dim, spread, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=dim) * spread).tolist()) for i in range(count)]


@pytest.mark.parametrize("spread", [1.0, 2.0**13, 2.0**40, 1e30])  # float64, integers of 64 bits, Python integers
def test_equals_brute_force(spark, spread):
    rows = random_rows(200, 5, spread)
    assert run(spark, rows, 5, 4, 3, 1024) == brute(rows, 5, 4, 3, 1024)


def test_one_wide_vector_among_narrow_ones(spark):
    rows = random_rows(100, 4, 1.0) + [(500, [1e15, -1e15, 0.0, 1.0]), (501, [-(2.0**31), 2.0**31, 3.0, 4.0])]
    found = run(spark, rows, 4, 3, 4, 1024)
    assert found == brute(rows, 4, 3, 4, 1024)


def test_edge_rows(spark):
    bad = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [float("inf"), 1.0, 2.0]), (7, [1e308, 0.0, 0.0])]
    good = [(8, [0.0, 0.0, 0.0]), (8, [0.0, 0.0, 0.0]), (9, [-0.0001, 0.0, -1.0]), (None, [5.0, 5.0, 5.0]), (None, [5.0, 5.0, 5.5]), (10, [1.0, 1.0, 1.0])]
    for k in (2, 20):
        assert run(spark, bad + good, 3, k, 5, 1024) == brute(bad + good, 3, k, 5, 1024)
    assert len(run(spark, bad + good, 3, 2, 5, 1024)) == len(good)


def test_equal_vectors_go_to_the_smallest_number(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)]  # all first centroids are equal, all but one stay empty
    found = run(spark, rows, 2, 4, 2, 1)
    assert found == brute(rows, 2, 4, 2, 1) and {r[1] for r in found} == {0}


def test_empty(spark):
    assert run(spark, [], 3, 2, 2, 1) == []


@pytest.mark.parametrize("most", [100, 1 << 25, 1 << 40])
def test_nearest_at_the_bounds(most):
    rng = np.random.default_rng(5)
    points = rng.integers(-most, most, (300, 7)).astype(np.float64)
    rows = rng.integers(-most, most, (5, 7)).tolist()
    number, distance = centroids.Centroids(rows).nearest(points)
    exact = [[sum((int(a) - b) ** 2 for a, b in zip(p, row)) for row in rows] for p in points]
    assert number.tolist() == [d.index(min(d)) for d in exact] and [int(d) for d in distance] == [min(d) for d in exact]
