"""Clustering against plain Python integers."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest

from lodestone.llm import centroids
from lodestone.llm.centroids import Settings

from .conftest import sorted_rows


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, s):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == s.dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(s.scale * x) for x in e]))
    draw = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{s.salt}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in draw[: s.clusters]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), k) for k, x in enumerate(c))

    for _ in range(s.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for k, vs in groups.items():
            c[k] = [sum(col) // len(vs) for col in zip(*vs)]
    out = [(i, k, d) for i, v in kept for d, k in [place(v)]]
    own = {}
    for _, k, d in out:
        own[k] = own.get(k, 0) + d
    return [(i, k, d, own[k], sum(own.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in out]


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    spread = [rng.choice([0.02, 0.1, 1.0]) for _ in range(64)]
    middles = [[rng.gauss(0, 1) * w for w in spread] for _ in range(12)]
    out = [(i, [single(m + rng.gauss(0, 0.2) * w) for m, w in zip(rng.choice(middles), spread)]) for i in range(260)]
    out += [(1000 + i, [0.5] * 64) for i in range(90)]  # one very common vector
    out += [(1, [single(rng.random()) for _ in range(64)]), (None, [0.25] * 64), (None, [single(rng.random()) for _ in range(64)])]
    broken = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0] * 63 + [float("-inf")]]
    return out + [(2000 + i, e) for i, e in enumerate(broken)]


def frame(spark, rows):
    table = [(i, e, 1, "x", 2, "y") for i, e in rows]
    return spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, cluster string, distance int, dim string").repartition(3)


def test_clusters_equal_brute_force(spark, rows):
    s = Settings()
    got = centroids.cluster(frame(spark, rows), s)
    assert sorted_rows(got, *COLUMNS) == sorted(brute(rows, s), key=repr)


def test_ties_and_empty_clusters(spark):
    """Equal vectors: all but the first of equal centroids stay empty and keep their place."""
    rows = [(i, [float(i % 3)] * 4) for i in range(30)]
    s = Settings(clusters=8, rounds=3, dims=4, scale=2)
    got = centroids.cluster(frame(spark, rows), s)
    assert sorted_rows(got, *COLUMNS) == sorted(brute(rows, s), key=repr)


def test_few_and_no_vectors(spark, rows):
    s = Settings()
    few = rows[:5]
    assert sorted_rows(centroids.cluster(frame(spark, few), s), *COLUMNS) == sorted(brute(few, s), key=repr)
    none = centroids.cluster(frame(spark, [(1, None), (2, [1.0])]), s)
    assert none.columns == list(COLUMNS) and none.collect() == []


def test_components_beyond_exact_range_are_left_out(spark):
    rows = [(1, [1e30] * 4), (2, [float(1 << 27)] * 4), (3, [-float(1 << 27)] * 4), (4, [float((1 << 27) + 16)] + [0.0] * 3), (5, [-float((1 << 27) + 16)] * 4)]
    got = centroids.cluster(frame(spark, rows), Settings(clusters=1, rounds=0, dims=4, scale=1)).collect()
    assert sorted(r["vec_id"] for r in got) == [2, 3]
    assert {r["distance"] for r in got} == {0, 4 * (1 << 28) ** 2}


def test_partial_search_equals_full_search_in_any_order():
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (5000, 64))
    c = np.concatenate((x[:30], x[:5], x[:5] + 1))
    want = ((x[:, None] - c[None]) ** 2).sum(2)
    for order in (np.arange(64), rng.permutation(64)):
        k, d = centroids.nearest(x, c, order)
        assert (k == want.argmin(1)).all() and (d == want.min(1)).all()
