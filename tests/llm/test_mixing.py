import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import mixing
from reviewmill.llm.features import BUCKETS, features
from reviewmill.llm.words import WordHashes

SIZES = {"aa": 240, "bb": 90, "cc": 30}


@pytest.fixture
def rows(prose):
    out = []
    for lang, n in SIZES.items():
        for i in range(n):
            out.append((len(out), " ".join(lang + w for w in prose(f"{lang}{i}", 40)), lang, "s"))
    return out


@pytest.fixture
def labelled(spark, rows):
    return spark.createDataFrame([(r[0],) for r in rows if r[0] % 2], "doc_id bigint")


def test_classifier_tells_domains_apart(documents, rows, labelled):
    got = {r["doc_id"]: r for r in mixing.mix(documents(rows), labelled).collect()}
    assert all(got[i]["domain"] == lang and sum(got[i]["posterior"]) == 1000 for i, _, lang, _ in rows)


@pytest.mark.parametrize("weights", [{"aa": 1, "bb": 1, "cc": 1}, {"aa": 5, "bb": 3, "cc": 2}, {"aa": 1, "bb": 0, "cc": 1}])
def test_expected_tokens_meet_the_targets(documents, rows, labelled, weights):
    total = 12_000.0
    mixed = mixing.mix(documents(rows), labelled, weights, total).cache()
    for d, name in enumerate(sorted(SIZES, key=SIZES.get, reverse=True)):
        share = F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[d] / 1000)
        wanted = total * weights[name] / sum(weights.values())
        assert mixed.agg(share).first()[0] == pytest.approx(wanted, abs=0.01 * total)
    assert mixed.agg(F.min("rate")).first()[0] >= 0


def test_least_rate_and_copies(documents, rows, labelled):
    table = documents(rows + [(None, "aaw1 aaw2", "aa", "s")])
    mixed = mixing.mix(table, labelled, least=1.0).cache()
    assert mixed.agg(F.min("copies")).first()[0] >= 1
    out = mixing.copies(table, mixed)
    assert out.columns == table.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert {r["doc_id"]: r["copies"] for r in mixed.where("doc_id IS NOT NULL").collect()} == {k: v for k, v in times.items() if k is not None}
    assert out.where("doc_id IS NULL").count() == 1
    some = mixing.mix(table, labelled, {"aa": 1, "bb": 1, "cc": 0})
    assert mixing.copies(table, some).where("lang = 'cc'").count() == 0


def test_rates_do_not_depend_on_partitions(documents, rows, labelled):
    one = mixing.mix(documents(rows), labelled).collect()
    other = mixing.mix(documents(rows).repartition(9), labelled).collect()
    assert {(r["doc_id"], r["copies"], round(r["rate"], 6)) for r in one} == {(r["doc_id"], r["copies"], round(r["rate"], 6)) for r in other}


def test_edge_cases(spark, documents, rows, labelled):
    none = spark.createDataFrame([], "doc_id bigint")
    got = mixing.mix(documents(rows[:3]), none).collect()
    assert [(r["rate"], r["copies"], r["domain"]) for r in got] == [(1.0, 1, None)] * 3
    odd = [(9000, None, None, None), (9001, "", "aa", None), (None, "bbw1", "bb", "s"), (9002, "aaw1 " * 20_000, "zz", "s"), (1, rows[1][1], "aa", "s")]
    got = mixing.mix(documents(rows + odd), labelled).collect()
    assert len(got) == len(rows) + len(odd) and all(r["rate"] >= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (9000, 9001)} == {0}
    assert mixing.mix(documents([]), labelled).collect() == []


def test_targets_out_of_reach_are_errors(documents, rows, labelled):
    with pytest.raises(ValueError, match="fr"):
        mixing.mix(documents(rows), labelled, {"aa": 1, "bb": 1, "fr": 8}, 100)
    mixing.mix(documents(rows), labelled, {"aa": 1, "bb": 1, "fr": 0}, 100)


def test_domains_beyond_the_most_frequent_share_a_class(documents, rows, labelled):
    more = rows + [(1000 + i, " ".join(f"dd{w}x{i % 7}" for w in range(40)), "dd", "s") for i in range(8)]
    known = labelled.union(labelled.sparkSession.range(1000, 1008).toDF("doc_id"))
    weights = {"aa": 1, "bb": 1, None: 2}
    got = mixing.mix(documents(more), known, weights, 12_000.0, most=2).collect()
    assert {r["domain"] for r in got if r["doc_id"] >= 330} == {None}
    left = {r["domain"]: r for r in mixing.residuals(documents(more), known, weights, 12_000.0, most=2).collect()}
    assert set(left) == {"aa", "bb", None} and left[None]["wanted"] == pytest.approx(6000)
    assert all(r["reached"] == pytest.approx(r["wanted"], abs=120) for r in left.values())
    with pytest.raises(ValueError, match="cc"):
        mixing.mix(documents(more), known, {"aa": 1, "cc": 1}, 100, most=2)


def test_posteriors_rates_and_copies_equal_a_plain_model(documents, rows, labelled):
    weights, total = {"aa": 2, "bb": 3, "cc": 4}, 15_000.0
    table = documents(rows)
    got = {r["doc_id"]: r for r in mixing.mix(table, labelled, weights, total).collect()}
    domains = sorted(SIZES, key=SIZES.get, reverse=True)
    buckets = {i: features([text.encode()], WordHashes())[1].tolist() for i, text, *_ in rows}
    every = collections.Counter(b for own in buckets.values() for b in own)
    n_all, counts = sum(every.values()), {d: collections.Counter() for d in domains}
    for i, _, lang, _ in rows:
        if i % 2:
            counts[lang].update(buckets[i])
    sizes = {d: sum(counts[d].values()) for d in domains}
    shares = {}
    for i, text, *_ in rows:
        logits = []
        for d in domains:
            chance = lambda b: (counts[d][b] + mixing.SMOOTHING * (every[b] + 1) / (n_all + BUCKETS)) / (sizes[d] + mixing.SMOOTHING)  # noqa: E731, B023
            mean = sum(math.log(chance(b)) for b in buckets[i]) / len(buckets[i])
            logits.append(mean * min(len(buckets[i]), mixing.EVIDENCE) + math.log((sizes[d] + 1) / (sum(sizes.values()) + len(domains))))
        odds = [math.exp(x - max(logits)) for x in logits]
        shares[i] = [1000 * o / sum(odds) for o in odds]
        assert all(abs(p - q) < 3 for p, q in zip(got[i]["posterior"], shares[i], strict=True))
        assert got[i]["n_tokens"] == len(text.split())
    posterior = np.array([got[r[0]]["posterior"] for r in rows]) / 1000
    tokens = np.array([len(r[1].split()) for r in rows], float)
    wanted = total * np.array([weights[d] for d in domains]) / sum(weights.values())
    scale = np.maximum(wanted, 1e-3 * total) ** 2
    bound = posterior @ ((posterior.T @ tokens) / scale)
    rate, reached = np.ones(len(rows)), posterior.T @ tokens
    for _ in range(mixing.STEPS):
        rate = np.maximum(0, rate - posterior @ ((reached - wanted) / scale) / bound)
        reached = posterior.T @ (tokens * rate)
        if np.abs((reached - wanted) / np.sqrt(scale)).max() < mixing.CLOSE:
            break
    for r, expected in zip(rows, rate, strict=True):
        assert got[r[0]]["rate"] == pytest.approx(expected, abs=0.02)
        assert math.floor(got[r[0]]["rate"]) <= got[r[0]]["copies"] <= math.floor(got[r[0]]["rate"]) + 1
    left = {r["domain"]: r["reached"] for r in mixing.residuals(table, labelled, weights, total).collect()}
    assert [left[d] for d in domains] == pytest.approx(wanted.tolist(), rel=2e-3)
