import collections
import math
import os

import numpy as np
import pytest

from reviewmill.llm import segmentation
from reviewmill.llm.queries import MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the model file isn't there")


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.Vocabulary(MODEL)


def every_path(text, v):
    """{ids: log probability} of all segmentations, by recursion over the model's own pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    full = " " + text if text else ""

    def rest(at):
        if at == len(full):
            yield (), 0.0
        for n in range(1, min(v.longest, len(full) - at) + 1):
            part = full[at : at + n]
            own = None if "▁" in part else pieces.get(part.replace(" ", "▁"))
            if own is None and n == 1:
                ids, weight = tuple(b + 3 for b in part.encode()), len(part.encode()) * v.byte_weight
            elif own is None:
                continue
            else:
                ids, weight = (own,), v.weight[own]
            for more, w in rest(at + n):
                yield ids + more, weight + w

    paths = list(rest(0))
    total = math.log(sum(math.exp(w) for _, w in paths))
    return {ids: w - total for ids, w in paths}


@pytest.mark.parametrize("text", ["the cat", "a", "Hello\nx", "é▁ z  ñ", "日本", "ab\tcd"])
def test_draws_without_replacement(vocabulary, text):
    paths, n, k = every_path(text, vocabulary), 3000, 3
    drawn = segmentation.draw([text] * n, np.arange(n), vocabulary, k)
    first, second, total = collections.Counter(), collections.Counter(), 0.0
    for own in drawn:
        ids = [tuple(d[0].tolist()) for d in own]
        assert len(set(ids)) == len(ids) == min(k, len(paths))
        for i, (_, log_prob, inclusion) in zip(ids, own, strict=True):
            assert log_prob == pytest.approx(paths[i], abs=1e-4)
            total += math.exp(log_prob) / inclusion
        first[ids[0]] += 1
        second[tuple(ids[:2])] += 1
    spread = 4 / math.sqrt(n)
    assert all(abs(first[i] / n - math.exp(p)) < spread for i, p in paths.items())
    for ids, seen in second.items():
        if len(ids) == 2:
            a, b = (math.exp(paths[i]) for i in ids)
            assert abs(seen / n - a * b / (1 - a)) < spread
    assert total / n == pytest.approx(1, abs=0.05)  # inclusion scores make sums over the draws unbiased


def test_round_trip_and_batches(vocabulary):
    texts = ["", " ", "\n", "  a  b\n\n\tc ", "▁x▁ ▁", "é😀漢字\r\n<0x41> </s>", "sampling segmentations of something " * 60, "x" * 5000, "ab " * 3000]
    keys = np.arange(len(texts))
    drawn = segmentation.draw(texts, keys, vocabulary, 2)
    for text, own in zip(texts, drawn, strict=True):
        assert all(vocabulary.decode(d[0].tolist()) == text for d in own)
    alone = segmentation.draw(texts[6:7], keys[6:7], vocabulary, 2)[0]
    assert [d[0].tolist() for d in alone] == [d[0].tolist() for d in drawn[6]]
    other = segmentation.draw(texts[6:7], np.array([77]), vocabulary, 2)[0]
    assert other[0][0].tolist() != drawn[6][0][0].tolist()


def test_encode_and_decode_tables(documents):
    rows = [(1, "Some text of words"), (1, "Some text of words"), (2, None), (3, ""), (None, "null key"), (4, "long " * 10_000)]
    got = segmentation.encode(documents(rows), MODEL, k=3)
    found = got.collect()
    assert all(r["round_trip"] for r in found if r["doc_id"] != 2)
    ranks = collections.Counter(r["doc_id"] for r in found)
    assert ranks == {1: 6, 2: 1, 3: 1, None: 3, 4: 3}
    assert all(r["n_pieces"] == 0 and r["inclusion"] == 1 for r in found if r["doc_id"] in (2, 3))
    texts = {(r["doc_id"], r["decoded"]) for r in segmentation.decode(got, MODEL).collect()}
    assert texts == {(i, t or "") for i, t in rows}
    lean = segmentation.encode(documents(rows), MODEL, k=3, kept=0, returned=1)
    assert sorted(map(str, lean.collect())) == sorted(map(str, found))
    assert segmentation.encode(documents([]), MODEL).collect() == []


def test_kept_lattices_change_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(segmentation, "KEPT", 40)
    blocks = [["the cat sat", "é▁ z", ""], ["the cat ran far away " * 9, "日本 sat"], [], ["sat the", "new words here\nthe"]]
    lattices = segmentation.KeptLattices(vocabulary)
    for texts in blocks:
        keys = np.arange(len(texts))
        got = segmentation.draw(texts, keys, vocabulary, 3, lattices=lattices)
        lattices.trim()
        assert lattices.nodes <= 40 and len(lattices.index) == len(lattices.start)
        for own, fresh in zip(got, segmentation.draw(texts, keys, vocabulary, 3), strict=True):
            assert [(a.tolist(), p, q) for a, p, q in own] == [(a.tolist(), p, q) for a, p, q in fresh]


def test_texts_share_passes_over_their_lattices(vocabulary, monkeypatch):
    calls, plain = [], segmentation.Lattices.log_share
    monkeypatch.setattr(segmentation.Lattices, "log_share", lambda *a: calls.append(1) or plain(*a))
    texts, k = ["the cat sat on a mat", "é▁ z", "sampling\nsegmentations"], 3
    segmentation.draw(texts, np.arange(3), vocabulary, k)
    few, calls[:] = len(calls), []
    segmentation.draw(texts * 20, np.arange(60), vocabulary, k)
    assert len(calls) == few <= 2 * k


def test_steps_by_halving(vocabulary):
    lattices = segmentation.Lattices([" the", "internationalisation", "é日", "\n", " " * 20], vocabulary)
    node = np.arange(len(lattices.code))
    for u in (0.0, 0.1, 0.5, 0.9, float(np.nextafter(np.float32(1), np.float32(0))), 1.0):
        step = lattices.steps(node, np.full(len(node), u, np.float32))
        for n, row in enumerate(lattices.cumulative):
            above = np.flatnonzero(row > np.float32(u))
            assert step[n] == (above[0] + 1 if len(above) else lattices.longest[n])
