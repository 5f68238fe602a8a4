import collections
import math
import zlib

import numpy as np
import pytest

from reviewmill.llm import katz


class Model:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.tokens = [(t or "").encode().lower().split() + [None] for t in texts]
        self.words, self.pairs = collections.Counter(), collections.Counter()
        for t in self.tokens:
            self.words.update(t)
            self.pairs.update(zip(["start", *t[:-1]], t, strict=True))
        self.n = sum(self.words.values())
        self.d1, self.d2 = (self.factors(c) for c in (self.words, self.pairs))
        self.history = dict(self.words) | {"start": len(texts)}
        self.left = 1 + self.saved(self.words.values(), self.d1)
        self.next = collections.defaultdict(list)
        for (h, w), c in self.pairs.items():
            self.next[h].append((w, c))

    def factors(self, counts):
        often = collections.Counter(counts.values())
        return katz.good_turing([often[r] for r in range(1, katz.LARGE + 2)])

    def saved(self, counts, d):
        return sum((1 - d[c]) * c for c in counts if c <= katz.LARGE)

    def kept(self, c, d):
        return c * (d[c] if c <= katz.LARGE else 1)

    def p(self, w, h=False):
        if h is False or not self.history.get(h):
            c = self.words.get(w, 0)
            return (self.kept(c, self.d1) if c else self.left) / (self.n + 1)
        c = self.pairs.get((h, w), 0)
        total = self.history[h] + 1
        if c:
            return self.kept(c, self.d2) / total
        free = (1 + self.saved([c for _, c in self.next[h]], self.d2)) / total
        return free / (1 - sum(self.p(w) for w, _ in self.next[h])) * self.p(w)


def taught(doc_id):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 5 != 1


@pytest.fixture
def rows(prose):
    texts = [" ".join(prose(i, 5 + 7 * i % 120)).upper() for i in range(120)]
    texts += [None, "", " \n", "unknown words only", "the the the the", "w1 " * 3000]
    return list(enumerate(texts)) + [(None, "w1 w2"), (3, texts[3])]


@pytest.mark.parametrize("size", [1 << 30, 2000])
def test_equals_dictionaries(documents, rows, monkeypatch, size):
    monkeypatch.setattr(katz, "BLOCK_BYTES", size)
    monkeypatch.setattr(katz, "BUCKET_BYTES", size)
    model = Model([t for i, t in rows if taught(i)])
    got = katz.score_texts(documents(rows)).collect()
    assert len(got) == len(rows)
    expected = collections.defaultdict(list)
    for i, text in rows:
        tokens = (text or "").encode().lower().split() + [None]
        score = sum(math.log10(model.p(w, h)) for h, w in zip(["start", *tokens[:-1]], tokens, strict=True))
        base = sum(math.log10((model.words[w] + 0.5) / (model.n + 0.5 * (len(model.words) + 1))) for w in tokens)
        expected[i].append((len(tokens), sum(model.words[w] > 0 for w in tokens), base, score))
    for r in got:
        n, known, base, score = expected[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"]) == (n, known, not taught(r["doc_id"]), model.n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-9)


def test_distributions_add_up_to_one(rows):
    model = Model([t for i, t in rows if taught(i)])
    for h in ("start", b"w1", b"w7", b"the", b"never"):
        total = sum(model.p(w, h) for w in model.words) + model.p("unknown", h)
        assert total == pytest.approx(1, abs=1e-9)


def test_better_than_the_base_on_held_out_text(documents):
    texts = [(i, " ".join(f"a{(i + j) % 50}" for j in range(60))) for i in range(200)]
    held = [r for r in katz.score_texts(documents(texts)).collect() if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_empty_table_and_no_training_texts(documents):
    assert katz.score_texts(documents([])).collect() == []
    held = next(i for i in range(100) if not taught(i))
    row = katz.score_texts(documents([(held, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["score"]) == (3, 0, 0, 0.0)


def test_discounts():
    for counts in ([100, 30, 12, 7, 4, 3], [10, 30, 5, 40, 2, 9], [0] * 6, [5, 4, 3, 0, 1, 1], [9, 9, 9, 9, 9, 9]):
        factors = katz.good_turing(counts)
        assert factors[0] == 0 and ((factors[1:] > 0) & (factors[1:] < 1)).all()


def test_packing():
    for kind in (np.int32, np.int64, np.float64):
        values = np.arange(-5, 1000).astype(kind)
        assert (katz.unpack(katz.pack(values), kind) == values).all()
        assert len(katz.unpack(katz.pack(values[:0]), kind)) == 0


def test_steps_are_packed_smaller_where_numbers_are_sorted():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for kind, some in ((np.uint64, values), (np.uint64, values[::-1]), (np.int64, values.view(np.int64)), (np.int64, values[:0].view(np.int64))):
        assert (katz.unpack_steps(katz.pack_steps(some), kind) == some).all()
    assert len(katz.pack_steps(values)) < len(katz.pack(values))


def test_what_travels_per_token_and_pair(documents, prose, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_BYTES", 50_000)
    sent, steps = {}, {f: getattr(katz, f) for f in ("token_blocks", "count_words", "word_pairs")}

    def watched(name):
        def run(*args):
            rows = steps[name](*args)
            sent[name] = rows.collect()
            return rows

        return run

    for name in steps:
        monkeypatch.setattr(katz, name, watched(name))
    texts = [" ".join(w for a, b in zip(prose(i, 400), prose(-i, 400), strict=True) for w in (min(a, b), f"{a}{b[:2]}")) for i in range(400)]
    got = katz.score_texts(documents(list(enumerate(texts)))).collect()
    tokens = sum(r["n_tokens"] for r in got)
    assert tokens == 400 * 801
    assert sum(len(v) for r in sent["token_blocks"] for v in r if isinstance(v, bytes | bytearray)) < 1.5 * tokens
    kinds = {"h": np.int64, "ch": np.int64, "cw": np.int64, "seen": np.int32}
    numbers = {c: sum(len(katz.unpack(r[c], kind)) for r in sent["word_pairs"] if r["h"]) for c, kind in kinds.items()}
    assert numbers["h"] == numbers["ch"] < 0.5 * numbers["seen"] and numbers["cw"] < 0.7 * numbers["seen"]
