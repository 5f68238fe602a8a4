import math
import random
from collections import Counter

import numpy as np
import pytest

from reviewmill.llm import resampling
from reviewmill.llm.features import features
from reviewmill.llm.selection import largest
from reviewmill.llm.words import WordHashes


def corpus(prose, n=400):
    rows, good = [], []
    for i in range(n):
        words = prose(i, 120)
        if i % 4 == 0:
            words = [w + "***" for w in words]
        elif i % 3:
            good.append((i,))
        rows.append((i, " ".join(words)))
    return rows, good


def test_rejects_text_unlike_the_target(spark, documents, prose):
    rows, good = corpus(prose)
    labelled = spark.createDataFrame(good, "doc_id bigint")
    got = {r["doc_id"]: r["kept"] for r in resampling.resample(documents(rows), labelled).collect()}
    clean = [got[i] for i, _ in rows if i % 4]
    assert sum(clean) >= 0.97 * len(clean)
    assert not any(got[i] for i, _ in rows if i % 4 == 0)


def test_draw_has_the_size_asked_and_depends_on_ids_alone(spark, documents, prose):
    rows, good = corpus(prose, 120)
    labelled = spark.createDataFrame(good, "doc_id bigint")
    one = resampling.resample(documents(rows), labelled, k=30)
    other = resampling.resample(documents(rows[::-1]).repartition(7), labelled, k=30)
    assert one.where("kept").count() == 30
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in other.collect()}


def test_edge_cases(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint")
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 20_000), (3, "x " * 20_000)]
    got = resampling.resample(documents(rows), none).collect()
    assert len(got) == 5 and all(r["kept"] and r["log_weight"] == 0 for r in got)
    labelled = spark.createDataFrame([(3,), (None,), (99,)], "doc_id bigint")
    assert resampling.resample(documents(rows), labelled).count() == 5
    assert resampling.resample(documents([]), labelled).collect() == []
    zero = resampling.resample(documents(rows), labelled, k=0)
    assert zero.where("kept").count() == 0


@pytest.mark.parametrize("n", [600, 2400])
def test_toxic_documents_go_and_clean_ones_of_each_language_stay(spark, documents, prose, n):
    random_ = random.Random(n)
    rows, good, toxic = [], [], []
    for i in range(n):
        lang = "de" if i % 4 == 0 else "en"  # one in six of the one is labelled, four in six of the other
        words = [lang + w for w in prose(i, random_.choice([30, 120, 500]))]
        if i % 10 == 7:
            toxic.append(i)
            for _ in range(6):
                words.insert(random_.randrange(len(words)), random_.choice(["trash", "scum", "idiot", "moron"]))
        elif i // 4 % 6 < (1 if lang == "de" else 4):
            good.append((i,))
        rows.append((i, " ".join(words), lang))
    labelled = spark.createDataFrame(good, "doc_id bigint")
    got = {r["doc_id"]: r["kept"] for r in resampling.resample(documents(rows), labelled).collect()}
    assert sum(got[i] for i in toxic) <= 0.1 * len(toxic)
    for lang in ("de", "en"):
        clean = [got[i] for i, _, of in rows if of == lang and i not in toxic]
        assert sum(clean) >= 0.9 * len(clean), lang


@pytest.mark.parametrize("k", [0, 1, 7, 50, 199, 200, 500])
def test_largest_equals_a_sort(spark, k):
    random_ = random.Random(k)
    rows = [(random_.choice([-(1 << 62), -1, 0, 5, 1 << 40]) + random_.randint(0, 3), i) for i in range(200)]
    table = spark.createDataFrame(rows, "a bigint, b bigint")
    got = [tuple(r) for r in table.where(largest(table, k, ["a", "b"])).collect()]
    assert sorted(got) == sorted(rows)[max(0, 200 - k) :]


def test_rows_equal_in_all_keys_go_together(spark):
    table = spark.createDataFrame([(5,), (5,), (1,)], "a bigint")
    assert table.where(largest(table, 1, ["a"])).count() == 2


def test_equals_plain_dictionaries(spark, documents, prose, monkeypatch):
    """Log weights, bounds, keys and the draw recomputed without the library's models."""
    monkeypatch.setattr(resampling, "LEAST_LABELLED", 5)
    rows = [(i, " ".join(w + ("***" if i % 7 == 0 else "") for w in prose(i, 40 + i)), "en" if i % 3 else "de") for i in range(90)]
    rows += [(200 + i, rows[i][1], "en") for i in (1, 2, 7, 8)] + [(None, rows[5][1], "en"), (300, None, "en"), (300, "", None)]
    good = {i for i in range(90) if i % 7 and i % 5}
    labelled = spark.createDataFrame([(i,) for i in sorted(good)], "doc_id bigint")
    made = documents(rows)
    got = [tuple(r) for r in resampling.resample(made, labelled).collect()]
    hashed = made.selectExpr("doc_id", "text", "lang", "xxhash64(coalesce(text, '')) AS h", "xxhash64(doc_id, 42) AS g").collect()

    docs = []
    for r in hashed:
        _, buckets = features([(r["text"] or "").encode()], WordHashes())
        docs.append((r["doc_id"], Counter(buckets.tolist()), r["lang"], r["h"] % resampling.FOLDS, r["g"] % (1 << 52)))
    models = {}
    for lang in {d[2] for d in docs}:
        for fold in range(resampling.FOLDS):
            target, every = Counter(), Counter()
            for i, counts, of, f, _ in docs:
                if of == lang and f != fold:
                    every.update(counts)
                    if i in good:
                        target.update(counts)
            models[lang, fold] = target, every

    def log_weight(counts, lang, fold):
        target, every = models[lang, fold]
        share = target.total() / max(every.total(), 1)
        smooth, total = resampling.SMOOTHING * max(target.total(), 1), 0.0
        for bucket, n in counts.items():
            expected = every[bucket] * share
            errors = (target[bucket] - expected) ** 2 / (expected * (1 - share) + 0.5)
            total += n * math.log((target[bucket] + smooth) / (expected + smooth)) * (errors / (errors + resampling.EVIDENCE)) ** 2
        return total

    scored = [(i, c.total(), log_weight(c, lang, fold), lang, g) for i, c, lang, fold, g in docs]
    groups = {}
    for i, n, w, lang, _ in scored:
        if i in good and n:
            for key in ((lang, n.bit_length()), (lang, None), None):
                groups.setdefault(key, []).append(w / math.sqrt(n))

    def bound(lang, n):
        for key in ((lang, n.bit_length()), (lang, None), None):
            if key is None or len(groups.get(key, ())) >= 5:
                low, high = np.percentile(groups[key], [25, 75])
                known = lang in {"en", "de"}
                return min((low - resampling.REACH * (high - low)) * math.sqrt(n) if known else 0.0, -resampling.ODDS)

    above = [w - bound(lang, n) for _, n, w, lang, _ in scored]
    gumbel = [-math.log(-math.log((g + 0.5) / (1 << 52))) for *_, g in scored]
    keys = [math.floor((a + x) * (1 << 20)) for a, x in zip(above, gumbel)]
    last = sorted(keys, reverse=True)[sum(a >= 0 for a in above) - 1]
    want = [(i, n, w, k, k >= last) for (i, n, w, *_), k in zip(scored, keys)]
    order = lambda r: (r[0] is None, r[0], r[1])
    for mine, theirs in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert mine[:2] == theirs[:2] and mine[4] == theirs[4]
        assert mine[2] == pytest.approx(theirs[2], abs=1e-9) and abs(mine[3] - theirs[3]) <= 1
    weights = {}
    for (_, text, lang), row in zip([(r["doc_id"], r["text"], r["lang"]) for r in hashed], scored):
        assert weights.setdefault((text, lang), row[2]) == row[2]  # equal texts weigh the same
