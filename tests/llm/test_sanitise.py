import hashlib
import random
import re

from reviewmill.llm import sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def patterns(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and sanitise.luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    random_ = random.Random(5)
    for alphabet in ("a@.b-_ 1234567890+()\n@..1é", "0123456789 -", "+1(2) 34.5-6", "12.255.0.256.1"):
        for _ in range(8000):
            text = "".join(random_.choice(alphabet) for _ in range(random_.randint(0, 45)))
            assert sanitise.base_spans(text) == patterns(text), text


def test_luhn():
    assert sanitise.luhn("4111111111111111") and not sanitise.luhn("4111111111111112")


def test_long_digits_and_runs_stay_linear():
    sanitise.base_spans("1" * 300_000 + " " + "a." * 100_000 + "@" * 1000 + "+1" + " (" * 100_000)
    zeros = "0" * 5000
    assert sanitise.base_spans(f"{zeros}.1.1.1 {zeros}7.1.1.{zeros} {zeros}256.1.1.1") == [(1, 0, 5006), (1, 5007, 15013)]


def rows():
    out = [(i, f"Line {i} without data\nCall Agent Zorro{i} at spy@mail.example now Kingfisher{'' if i % 2 else '!'} x{i}") for i in range(6)]
    out += [(100 + i, f"call now at line {i} agent of nothing without data") for i in range(40)]
    return out


def test_terms_that_reveal_an_entity(documents):
    got = {r["doc_id"]: r for r in sanitise.find(documents(rows())).collect()}
    for i in range(6):
        text = rows()[i][1]
        terms = [text[t["start"] : t["end"]] for t in got[i]["terms"]]
        assert terms == ["Kingfisher"]  # the name differs from line to line, the other words are common
        start = text.index("Kingfisher")
        base = f"email:{text.index('spy@')}:{text.index('spy@') + 16}"
        assert got[i]["spans"] == f"{base},term:{start}:{start + 10}"
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert all(got[100 + i]["spans"] == "" for i in range(40))


def test_copies_of_a_line_are_no_evidence(documents):
    text = "Reach Kingfisher by spy@mail.example today"
    got = sanitise.find(documents([(i, text) for i in range(20)])).collect()
    assert all(r["terms"] is None and r["n_email"] == 1 for r in got)


def test_copies_of_revealing_lines_change_no_span(documents, prose):
    told = [f"Kingfisher {' '.join(prose(-i, 5))} spy@mail.example, Kingfisher!" for i in range(1, 4)]
    other = [(100 + i, " ".join(prose(i, 12))) for i in range(2000)]
    once = {r["doc_id"]: r["spans"] for r in sanitise.find(documents([*enumerate(told), *other])).collect()}
    rows = [(i, text) for i, text in enumerate(told) for _ in range(40)]
    copied = sanitise.find(documents([*rows, *other])).collect()
    assert all(once[i].count("term:") == 2 for i in range(3))
    assert len(copied) == 2120 and {(r["doc_id"], r["spans"]) for r in copied} == set(once.items())


def test_few_lines_are_evidence_as_far_as_chance_allows(documents, prose):
    told = ["Kingfisher {} spy@mail.example", "Osprey {} owl@birds.example", "Osprey {} jay@birds.example", "Single {} one@lone.example"]
    rows = [(i, told[k].format(" ".join(prose(-i, 4)))) for i, k in enumerate([0, 0, 1, 2, 3])]
    rows += [(100 + i, " ".join(prose(i, 12))) for i in range(2000)]
    got = {r["doc_id"]: r for r in sanitise.find(documents(rows)).collect()}
    terms = [[rows[i][1][t["start"] : t["end"]] for t in got[i]["terms"] or []] for i in range(5)]
    assert terms == [["Kingfisher"], ["Kingfisher"], ["Osprey"], ["Osprey"], []]
    assert all(r["terms"] is None for i, r in got.items() if i >= 100)


def test_sanitised_texts(documents):
    table = documents(rows() + [(None, "a@b.c x"), (7, None), (8, "")])
    got = {r["doc_id"]: r["text"] for r in sanitise.sanitised(table, sanitise.find(table)).collect()}
    assert len(got) == 49
    assert got[1] == "Line 1 without data\nCall Agent Zorro1 at <EMAIL> now  x1"
    assert got[100] == rows()[6][1] and got[None] == "<EMAIL> x" and got[7] is None and got[8] == ""
    assert sanitise.sanitised(table, sanitise.find(table)).columns == table.columns


def test_sanitised_keeps_columns_of_clashing_names(documents):
    table = documents([(1, "to a@b.cd now"), (2, "none")]).selectExpr("doc_id", "text", "'s' AS spans", "'t' AS terms", "'i' AS _id", "'u' AS _spans")
    got = sanitise.sanitised(table, sanitise.find(table)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "to <EMAIL> now", "s", "t", "i", "u"), (2, "none", "s", "t", "i", "u")]


def test_edge_cases(documents):
    empty = hashlib.sha256(b"").hexdigest()
    got = sanitise.find(documents([(1, None), (2, ""), (None, "x"), (3, "é 😀 a@b.cd"), (3, "é 😀 a@b.cd")])).collect()
    assert sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in got) == [
        ("1", 0, ""), ("2", 0, ""), ("3", 1, "email:4:10"), ("3", 1, "email:4:10"), ("None", 0, "")
    ]
    assert sum(r["base_sha256"] == empty for r in got) == 3
    assert sanitise.find(documents([])).collect() == []
