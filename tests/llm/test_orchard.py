import hashlib
import math
import random

import numpy as np
import pytest

from helpers import rows_of
from tritempo.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance long, key string, cells string"


def rows_with(spark, vectors):
    return spark.createDataFrame([(key, value, 1, 5, 6, "k", "c") for key, value in vectors], SCHEMA)


def plain(vectors, k, rounds, size, scale):
    """The contract by loops over whole numbers."""
    kept = [
        (key, [math.floor(scale * x) for x in value]) for key, value in vectors
        if value is not None and len(value) == size and all(x is not None and math.isfinite(x) for x in value)
    ]
    hashed = sorted((hashlib.sha256(f"1:{key}".encode()).hexdigest(), cells) for key, cells in kept if key is not None)
    centroids = [cells for _, cells in hashed[:k]]
    if not centroids:
        return []
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), number) for number, c in enumerate(centroids))
    for _ in range(rounds):
        got = {}
        for _, x in kept:
            got.setdefault(near(x)[1], []).append(x)
        for number, group in got.items():
            centroids[number] = [sum(column) // len(group) for column in zip(*group, strict=True)]
    own = [(key, *near(x)[::-1]) for key, x in kept]
    sums = {}
    for _, number, distance in own:
        sums[number] = sums.get(number, 0) + distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(key, number, distance, sums[number], sum(sums.values()), digest[number]) for key, number, distance in own]


@pytest.mark.parametrize("k", [1, 2, 16, 40])
def test_search_finds_the_nearest_and_compares_fewer(k):
    chosen = np.random.default_rng(k)
    centroids = chosen.integers(-9, 9, (k, 3)) if k < 40 else chosen.integers(-900, 900, (k, 3))
    centroids[k // 2] = centroids[0]  # equal centroids: the smaller number
    x = np.concatenate([chosen.integers(-9, 9, (500, 3)), centroids])
    own, distance, compared = orchard.Orchard(centroids).nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert own.tolist() == every.argmin(1).tolist() and distance.tolist() == every.min(1).tolist()
    assert compared.max() <= k and (k < 40 or compared.mean() < 20)


def test_a_centroid_at_exactly_twice_the_distance_is_still_compared():
    # the vector lies half way between both; it starts at the longer one, number 1
    own, distance, _ = orchard.Orchard(np.array([[2, 0], [6, 0]])).nearest(np.array([[4, 0], [5, 0]]))
    assert own.tolist() == [0, 1] and distance.tolist() == [4, 1]


def test_equals_the_plain_rule_on_odd_rows(spark):
    chosen = random.Random(4)
    point = lambda: [round(chosen.uniform(-2, 2), 1) for _ in range(3)]
    vectors = [(key, point()) for key in range(60)] + [(key, [0.5, 0.5, 0.5]) for key in range(60, 90)] + [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    vectors += [
        (100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 2.0]), (105, [float("inf"), 0.0, 0.0]),
        (None, [0.1, 0.2, 0.3]), (106, [0.0, 0.0, 0.0]),
    ]
    for k in (1, 5, 200):
        found = orchard.cluster_digests(rows_with(spark, vectors).repartition(4), k=k, size=3)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(rows_of(found), key=str) == sorted(plain(vectors, k, 3, 3, 64), key=str)


def test_without_vectors_and_with_very_large_numbers(spark):
    assert orchard.cluster_digests(rows_with(spark, [(1, None), (2, [1.0])])).count() == 0
    assert orchard.cluster_digests(rows_with(spark, []).filter("vec_id = 1")).count() == 0
    found = rows_of(orchard.cluster_digests(rows_with(spark, [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [1e300] * 64)] * 3), k=1))
    assert len(found) == 9 and all(row[4] <= orchard.LARGEST for row in found)
