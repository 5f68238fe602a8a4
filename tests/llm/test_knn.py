import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from reviewmill.llm import knn

SCHEMA = "vec_id bigint, embedding array<float>, v string, id bigint, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, "x", 3, 1) for i, e in rows], SCHEMA)


def brute(rows, k=20):
    def sound(e):
        return e is not None and all(x is not None and math.isfinite(x) for x in e)

    points = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if i is not None and sound(e)]
    out = []
    for a, (q, v) in enumerate(points):
        if q % 20 == 0:
            scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(v, e)))), i) for b, (i, e) in enumerate(points) if a != b]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, k=20):
    got = knn.search(table(spark, rows), F.col("id") % 20 == 0, k).collect()
    return sorted(tuple(r) for r in got)


@pytest.fixture
def vectors():
    random_ = random.Random(4)
    rows = [(i, [float(random_.randint(-9, 9)) / 8 for _ in range(8)]) for i in range(700)]
    return rows + [(1000 + i, rows[0][1]) for i in range(150)]  # many equal vectors: ties by id


def test_equals_brute_force(spark, vectors):
    assert found(spark, vectors) == brute(vectors)


def test_small_chunks_and_few_pivots(spark, vectors, monkeypatch):
    monkeypatch.setattr(knn, "CHUNK", 32)
    monkeypatch.setattr(knn, "PIVOTS", 5)
    assert found(spark, vectors, k=7) == brute(vectors, k=7)


def test_rows_that_take_no_part(spark):
    good = [(i, [i / 10, 1.0, -2.5]) for i in range(45)]
    bad = [(100, None), (120, [1.0, None, 2.0]), (140, [float("nan"), 0.0, 0.0]), (160, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    assert found(spark, good + bad) == brute(good)
    short = [(200, [2.0]), (220, [])]
    padded = [(200, [2.0, 0.0, 0.0]), (220, [0.0, 0.0, 0.0])]
    assert found(spark, good + short) == brute(good + padded)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e30])
def test_components_of_any_size(spark, size):
    random_ = random.Random(8)
    rows = [(i, [round(random_.uniform(-1, 1), 2) * size, random_.uniform(-9, 9), 1.0]) for i in range(90)]
    rows += [(100 + i, [0.0, random_.uniform(-9, 9), 1.0]) for i in range(60)]
    floats = [(i, [struct.unpack("f", struct.pack("f", x))[0] for x in e]) for i, e in rows]
    assert found(spark, rows) == brute(floats)


def test_fewer_rows_than_asked_repeats_and_empty_table(spark):
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [-1.0]), (20, [3.0]), (20, [3.0])]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == 15
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []
