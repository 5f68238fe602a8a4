import hashlib
import random

import pytest

from reviewmill.llm import byte_bpe
from reviewmill.llm.queries import op12_byte_level_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def table(ranks):
    return byte_bpe.PerfectHash(ranks)


TEXTS = [
    None,
    "",
    " ",
    "\n\n \t x",
    "It's we'll THEY'RE 'tis",
    "naïve café 日本語 한국어 é \U0001f600\U0001f600",
    "\x1c\x85 　 x​",
    "<|endoftext|>",
    "a" * 30_000,
    " " * 20_000,
    "qzx " * 10_000,
    "word and word " * 20_000,
]


def test_perfect_hash_is_minimal_and_exact(ranks, table):
    assert len(table.tokens) == table.n == len(ranks) and set(table.tokens) == set(ranks)
    assert table.find(list(ranks)) == list(ranks.values())
    assert table.find([b"", b"zqzqzqzq", b" the the"]) == [-1, -1, -1]
    assert byte_bpe.PerfectHash({}).find([b"a"]) == [-1]
    small = {bytes([i]): i * i for i in range(5)}
    assert byte_bpe.PerfectHash(small).find([*small, b"x"]) == [0, 1, 4, 9, 16, -1]


def test_merges_equal_a_plain_loop(ranks):
    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    random_ = random.Random(3)
    for _ in range(1500):
        piece = "".join(random_.choice(["a", "e", "t", "h", "in", "er", "é", "日", " "]) for _ in range(random_.randint(1, 40))).encode()
        assert byte_bpe.merged(piece, ranks) == plain(piece)


def test_every_character_equals_the_library(table, library):
    encoder = byte_bpe.Encoder(table, public_tokenizers.PATTERN)
    codes = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}x {chr(c)}" for c in codes]
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert int(counts.sum()) == len(ids)


def test_equals_the_library_and_decodes(spark, documents, ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    rows = [(i if i % 3 else None, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    encoded = byte_bpe.encode(documents(rows), ranks, public_tokenizers.PATTERN)
    got = [(r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.decode(encoded, ranks).collect()]
    want = [(i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark, documents, ranks):
    encoded = byte_bpe.encode(documents([]), ranks, public_tokenizers.PATTERN)
    assert byte_bpe.decode(encoded, ranks).collect() == []


def test_query(spark, documents, library, tmp_path):
    rows = list(enumerate(TEXTS))
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))

    def digest(value):
        return hashlib.sha256(value).hexdigest()

    want = set()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())))
    got = op12_byte_level_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in got.collect()} == want
