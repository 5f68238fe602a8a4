import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import hard_negatives
from reviewmill.llm.vectors import LONG

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, unit int, row int, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1, 2, 3) for i, e, label in rows], SCHEMA)


def floor(x):
    return math.floor(256 * x) if abs(x) < 1 << 40 else 256 * int(x)


def brute(rows, every=10):
    def sound(e):
        return e is not None and all(x is not None and math.isfinite(x) for x in e)

    points = [(i, [floor(x) for x in e], label) for i, e, label in rows if i is not None and label is not None and sound(e)]
    out = []
    for a, (i, v, label) in enumerate(points):
        if i % every:
            continue
        scored = [(max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(v, w)))), j, other) for b, (j, w, other) in enumerate(points) if a != b]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for score, j, _ in [r for r in scored if r[2] == label][:5]:
            near = [r for r in scored if r[2] != label and 80 * score <= 100 * r[0] <= 100 * score][:5]
            out += [(i, j, rank + 1, n, score, s) for rank, (s, n, _) in enumerate(near)]
    return sorted(out)


def found(spark, rows, every=10):
    out = hard_negatives.mine(table(spark, rows), F.col("id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture
def vectors():
    """Crowded groups of several labels, so that windows hold more rows than are asked for."""
    random_ = random.Random(3)
    centres = [[random_.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for i in range(600):
        c = random_.choice(centres)
        rows.append((i, [x + random_.gauss(0, 0.3) for x in c], random_.randint(0, 3)))
    return rows + [(1000 + i, rows[0][1], i % 4) for i in range(90)]  # equal vectors: ties by id


def test_equals_brute_force(spark, vectors):
    got = found(spark, vectors)
    assert got == brute(vectors) and len(got) > 500


def test_small_units_and_first_steps(spark, vectors, monkeypatch):
    for name in ("CHUNK", "NEAR", "BLOCK"):
        monkeypatch.setattr(hard_negatives, name, 16)
    assert found(spark, vectors) == brute(vectors)


def test_rows_that_take_no_part_and_repeated_ids(spark):
    good = [(i, [math.sin(i), math.cos(i), 1.0], i % 3) for i in range(60)]
    good += [(10, good[10][1], 1), (11, good[10][1], 2)]  # an anchor and another row repeated
    good += [(300, [], 1), (310, [2.0], 0)]  # shorter vectors
    bad = [(100, None, 1), (110, [1.0, None, 2.0], 1), (120, [float("nan")] * 3, 1), (130, [float("inf"), 0.0, 0.0], 1)]
    bad += [(None, [1.0, 1.0, 1.0], 1), (140, [1.0, 1.0, 1.0], None)]
    assert found(spark, good + bad) == brute(good)


@pytest.mark.parametrize("size", [1e4, 1e9, 1e25])
def test_components_of_any_size(spark, size):
    random_ = random.Random(9)
    rows = [(i, [random_.uniform(0.5, 1) * size for _ in range(3)], i % 2) for i in range(50)]
    rows += [(100 + i, [random_.uniform(-1, 1) for _ in range(3)], i % 2) for i in range(50)]
    assert found(spark, rows) == brute(rows)


def test_tables_without_results(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 2)]) == []  # no positive
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [5.0], 2)]) == []  # no negative in the window
    assert found(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)]) == []  # below 0 the window is empty


def test_cells_are_visited_by_falling_bounds_and_few_of_them():
    random_ = np.random.default_rng(2)
    a, b = random_.normal(size=9), random_.normal(size=7)
    sums = [s for s, _, _ in hard_negatives.falling(a, b)]
    assert len(sums) == 63 and sums == sorted(sums, reverse=True)
    words = [np.array([[0.0], [100.0]]), np.array([[0.0], [100.0]])]
    index = hard_negatives.Index(words, [np.ones(2), np.ones(2)], np.full((2, 2), 5000))
    vector = np.array([1.0, 1.0])
    assert index.route(vector, True, -math.inf, math.inf) == [6, 7]
    assert index.route(vector, False, 150.0, math.inf) == []
    assert index.route(vector, False, 50.0, math.inf) == [2, 3, 4, 5]
    assert index.route(vector, False, -50.0, 50.0) == [0, 1]
