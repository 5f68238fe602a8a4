import itertools
import random

import pytest
from pyspark.sql import functions as F

from reviewmill.llm import near_dup
from reviewmill.llm.components import connected_components


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    """{id: component} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def changed(words, seed, n):
    random_ = random.Random(seed)
    words = list(words)
    for at in random_.sample(range(len(words)), n):
        words[at] = f"new{seed}_{at}"
    return words


@pytest.fixture
def texts(prose):
    out = {}
    passage = prose("passage", 60)
    for g in range(12):
        base = prose(g, 40 + 30 * g)
        for c in range(7):
            out[len(out)] = " ".join(changed(base, 100 * g + c, c * len(base) // 60))
    for s in range(60):  # documents that share a passage but are not alike
        out[len(out)] = " ".join(passage + prose(1000 + s, 25 + s))
    crowd = prose("crowd", 120)
    for c in range(150):  # one large group of near copies, some of them too far from each other
        out[len(out)] = " ".join(changed(crowd, 5000 + c, 1 + c % 6))
    out |= {1000 + i: t for i, t in enumerate([None, "", " \t\n", "one two", "ONE  two", "one", "a b c d", "a b c d e", "é É", "É É"])}
    return out


def test_equals_brute_force(documents, texts):
    random_ = random.Random(3)
    rows = list(texts.items())
    random_.shuffle(rows)
    got = {r["doc_id"]: r for r in near_dup.classes(documents(rows)).collect()}
    components, sizes = brute(texts)
    assert {i: r["component_id"] for i, r in got.items()} == components
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_small_blocks_find_the_same(documents, texts, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "COLUMNS", 64)
    monkeypatch.setattr(near_dup, "STARS", 1)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.classes(documents(texts.items())).collect()}
    assert got == brute(texts)[0]


def test_repeated_rows_null_ids_and_long_texts(documents, prose):
    long = " ".join(prose("long", 60_000))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (None, None), (3, "x y"), (4, "X  Y"), (4, "other words")]
    found = near_dup.classes(documents(rows))
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in found.collect()}
    assert found.count() == 5
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (3, True)
    assert got[None] == (None, True)
    left = near_dup.first_of_each(documents(rows), found)
    assert left.columns == documents(rows).columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 3] + ([4] if got[4][1] else [])


def test_empty_table(documents):
    assert near_dup.classes(documents([])).collect() == []
    assert near_dup.first_of_each(documents([]), near_dup.classes(documents([]))).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r["id"]: r["component"] for r in found.collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}


def test_frequent_values_list_nobody_together(spark):
    """A value in many sets is no meeting place for sets that have enough rarer ones."""
    rows = [(i, 64, [7] + [100 * i + j for j in range(100, 163)]) for i in range(50)]
    sets = spark.createDataFrame(rows, "id bigint, n bigint, values array<bigint>")
    assert near_dup.retained_values(sets).count() == 0
    assert near_dup.retained_values(sets.withColumn("values", F.slice("values", 1, 64)), whole=True).count() == 0
