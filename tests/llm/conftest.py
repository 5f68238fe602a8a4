import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, id string, words string"


@pytest.fixture
def documents(spark):
    """Rows of (id, text[, lang, source]) as documents, with columns whose names operators use inside."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else (*row, "s")[:4]
            full.append((doc_id, text, lang, source, len(text or ""), 9, "x", "y"))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def prose():
    """A function of a seed and a number of words that writes that many words of a small vocabulary."""
    vocabulary = [f"w{i}" for i in range(400)]

    def write(seed, n):
        random_ = random.Random(seed)
        return [random_.choice(vocabulary) for _ in range(n)]

    return write
