import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.llm import line_dedup


def distance(a, b):
    """Edit distance of two word lists."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    lines = []
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for j, line in enumerate((text or "").encode().lower().split(b"\n")):
            if line.split():
                lines.append(((i, j), line.split()))
    gone = set()
    for at, (place, words) in enumerate(lines):
        for earlier, other in lines[:at]:
            long = min(len(words), len(other)) >= line_dedup.LEAST_WORDS and abs(len(words) - len(other)) <= 1
            if earlier < place and (words == other or long and distance(words, other) <= 1):
                gone.add(place)
                break
    return gone


@pytest.fixture
def rows(prose):
    random_ = random.Random(2)
    lines = [prose(i, random_.choice([1, 3, 7, 8, 9, 15, 40])) for i in range(40)]
    lines += [["r"] * n for n in (7, 8, 9, 10, 11)]
    texts = []
    for i in range(60):
        own = []
        for _ in range(random_.randint(1, 6)):
            words = list(random_.choice(lines))
            for _ in range(random_.choice([0, 0, 1, 1, 2])):
                at, kind = random_.randrange(len(words)), random_.randrange(3)
                if kind == 0:
                    words[at] = "zz"
                elif kind == 1:
                    words.insert(at, "yy")
                elif len(words) > 1:
                    del words[at]
            own.append(random_.choice([" ", "  ", "\t"]).join(words).upper())
        texts.append((i, "\n".join(own)))
    return texts + [(100, None), (101, ""), (102, "\n \n"), (103, texts[0][1])]


def test_equals_brute_force(documents, rows):
    got = line_dedup.dropped_lines(documents(rows)).collect()
    assert {(r["doc_id"], r["line_no"]) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))
    assert all((r["of_doc"], r["of_line"]) < (r["doc_id"], r["line_no"]) for r in got)


def test_texts_without_their_lines(documents, rows):
    table = documents(rows)
    gone = brute(rows)
    left = line_dedup.without_lines(table, line_dedup.by_document(line_dedup.dropped_lines(table)))
    assert left.columns == table.columns
    expected = {}
    for i, text in rows:
        if any(d == i for d, _ in gone):
            text = "\n".join(x for j, x in enumerate(text.split("\n")) if (i, j) not in gone)
            if not text.encode().split():
                continue
        expected[i] = text
    assert {r["doc_id"]: r["text"] for r in left.collect()} == expected


def test_exact_lines_only(documents, rows):
    got = line_dedup.dropped_lines(documents(rows), near=False).collect()
    seen, gone = set(), set()
    for i, text in rows:
        for j, line in enumerate((text or "").lower().split("\n")):
            words = tuple(line.split())
            if words and words in seen:
                gone.add((i, j))
            seen.add(words)
    assert {(r["doc_id"], r["line_no"]) for r in got} == gone


def test_one_edit(spark):
    words = ["a", "b", "ab"]
    random_ = random.Random(1)
    pairs = [([random_.choice(words) for _ in range(random_.randint(1, 5))], [random_.choice(words) for _ in range(random_.randint(1, 5))]) for _ in range(600)]
    table = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = [r["x"] for r in table.select(line_dedup.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [distance(a, b) <= 1 for a, b in pairs]


def test_null_ids_repeated_rows_long_lines_and_empty_table(documents, prose):
    long = " ".join(prose("long", 30_000))
    rows = [(None, long), (5, long), (5, long), (6, long + " more"), (7, "x\n" + long)]
    got = {(r["doc_id"], r["line_no"]) for r in line_dedup.dropped_lines(documents(rows)).collect()}
    assert got == {(6, 0), (7, 1)}
    assert line_dedup.dropped_lines(documents([])).collect() == []
    nothing = line_dedup.by_document(line_dedup.dropped_lines(documents([])))
    assert line_dedup.without_lines(documents([]), nothing).count() == 0


def test_lines_are_cut_and_spelled_for_a_whole_block_at_once():
    random_ = random.Random(3)
    signs = ["a", "B", "Zz", " ", "  ", "\t", "\n", "\r", "\v\f", "\x1c", "\x85", "\xa0", "é", "日", "😀", "\0"]
    for _ in range(200):
        values = [None if random_.random() < 0.1 else "".join(random_.choices(signs, k=random_.choice([0, 1, 5, 60]))).encode() for _ in range(5)]
        lines = line_dedup._Lines(values)
        plain = [(i, j, line.split()) for i, v in enumerate(values) for j, line in enumerate((v or b"").lower().split(b"\n")) if line.split()]
        assert list(zip(lines.text.tolist(), lines.number.tolist(), lines.n.tolist(), strict=True)) == [(i, j, len(w)) for i, j, w in plain]
        of = np.arange(len(plain))
        half = (lines.n + 1) // 2
        assert lines.first_words(lines.n, of) == [b" ".join(w) for _, _, w in plain]
        assert lines.first_words(half, of) == [b" ".join(w[: (len(w) + 1) // 2]) for _, _, w in plain]
        assert lines.last_words(half, of) == [b" ".join(w[len(w) // 2 :]) for _, _, w in plain]
