import hashlib
import random

import numpy as np
import pytest

from reviewmill.llm import clustering
from reviewmill.llm.vectors import LONG

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, v int, c string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x", 3, "y") for i, e in rows], SCHEMA)


def floor(x):
    return int(np.floor(256 * x)) if abs(x) < 1 << 40 else 256 * int(x)


def brute(rows, k=40, rounds=5, width=64):
    def sound(e):
        return e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e)

    points = [(i, [floor(x) for x in e]) for i, e in rows if sound(e)]
    keys = [(i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in points]
    centres = [v for _, _, v in sorted(keys)[:k]]

    def nearest(v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in points:
            members[nearest(v)[0]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for c, m in zip(centres, members)]
    found = [(i, *nearest(v)) for i, v in points]
    inertia = [min(LONG, sum(min(d, LONG) for _, c, d in found if c == n)) for n in range(len(centres))]
    total = min(LONG, sum(min(d, LONG) for _, _, d in found))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, min(d, LONG), inertia[c], total, digests[c]) for i, c, d in found), key=repr)


def found(spark, rows, **options):
    out = clustering.with_inertia(spark, *clustering.cluster(table(spark, rows), **options))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_equals_brute_force(spark):
    random_ = random.Random(7)
    rows = [(i, [random_.gauss(0, 0.2) for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # many equal vectors
    rows += [(2000, None), (2001, [1.0]), (2002, [float("nan")] * 64), (2003, [None] * 64), (2004, [float("inf")] + [0.0] * 63)]
    rows += [(None, rows[3][1]), (4, rows[4][1])]  # no id; a repeated row
    assert found(spark, rows) == brute(rows)


def test_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK", 7)
    random_ = random.Random(1)
    rows = [(i, [random_.randint(-2, 2) / 256 for _ in range(4)]) for i in range(200)]
    assert found(spark, rows, k=12, rounds=3, width=4) == brute(rows, k=12, rounds=3, width=4)


@pytest.mark.parametrize("size", [1e6, 1e12, 1e30])
def test_components_of_any_size(spark, size):
    random_ = random.Random(2)
    rows = [(i, [random_.uniform(-size, size) for _ in range(3)]) for i in range(40)]
    assert found(spark, rows, k=5, rounds=2, width=3) == brute(rows, k=5, rounds=2, width=3)


def test_fewer_vectors_than_clusters_and_empty_table(spark):
    rows = [(1, [0.5, 1.0]), (2, [2.0, -1.0])]
    assert found(spark, rows, width=2) == brute(rows, width=2)
    assert found(spark, [], width=2) == []
    assert found(spark, [(1, None)], width=2) == []


def test_threshold_algorithm_equals_all_distances():
    random_ = np.random.default_rng(5)
    for width, k in ((1, 1), (2, 9), (16, 30)):
        rows, centres = random_.integers(-4, 5, (500, width)), random_.integers(-4, 5, (k, width))
        far = ((rows[:, None, :] - centres[None]) ** 2).sum(2)
        at, best = clustering.nearest(rows, centres)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()
