import random
import re

from reviewmill.llm import quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n_dup = len(lines) - len(set(lines))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, n_dup, len(covered), failed


def values(row):
    return tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))


def test_signals_equal_brute_force(documents):
    random_ = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a b c a b c", "é   ñ x\x0bz\r\n", "a b c\na b c\n a b c", "x" * 100_000]
    pieces = ["a", "b", "c", "\n", " ", "  ", "|", "$x", "ü", "\t", "de\n"]
    texts += [" ".join(random_.choice(pieces) for _ in range(random_.randint(1, 200))) for _ in range(150)]
    got = {r["doc_id"]: r for r in rules.judge(documents(enumerate(texts))).collect()}
    assert {i: values(got[i]) for i in got} == {i: base(t) for i, t in enumerate(texts)}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())


def test_thresholds_follow_the_group(documents, prose):
    rows = []
    for i in range(600):  # words of ten characters are usual in one language and odd in the other
        lang, pad = ("xx", "abcdefg") if i % 2 else ("yy", "")
        rows.append((i, " ".join(w + pad for w in prose(i, 80)), lang, f"s{i % 3}"))
    odd = " ".join(w + "abcdefg" for w in prose("odd", 80))
    rows += [(1000, odd, "yy", "s0"), (1001, odd, "xx", "s0"), (1002, odd, None, None), (1003, odd, "yy", "rare")]
    rows += [(1004, " | ".join(prose("table", 80)), "yy", "s1")]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(documents(rows)).collect()}
    assert all(got[i] for i in range(600))
    assert (got[1000], got[1001], got[1003], got[1004]) == (False, True, False, False)
    assert got[1002] is not None


def test_sketches_merge_like_sums(spark):
    rates = [("en", f"s{i % 4}", "symbols", i * i) for i in range(2000)]
    whole = spark.createDataFrame(rates, "lang string, source string, signal string, v bigint")
    merged = rules.merge(rules.sketch(whole), 1)
    at_once = rules.merge(rules.sketch(whole.withColumn("source", whole["lang"])), 1)
    assert sorted(map(str, merged.collect())) == sorted(map(str, at_once.collect()))
    fence = rules.fences(merged).first()["fence"]
    q1, q3 = 500**2, 1500**2
    assert abs(fence["symbols_most"] - (q3 + 3 * (q3 - q1))) / (4 * q3) < 1 / 32


def test_tails_carry_on_and_end_where_they_break(spark):
    def most(values, signal="repeats"):
        rows = [("en", "s", signal, v) for v in values]
        df = spark.createDataFrame(rows, "lang string, source string, signal string, v bigint")
        return rules.fences(rules.sketch(df)).first()["fence"][f"{signal}_most"]

    nothing = [0] * 1000
    assert most(nothing) == rules.RESOLUTION
    shading = [0] * 880 + list(range(10, 1210, 10))  # an eighth above zero, up to 1200
    q90, q99 = 200, 1100
    assert abs(most(shading) - (q99 + rules.FURTHER * (q99 - q90))) < 100
    assert most([x // 4 for x in shading]) < most(shading) / 3
    apart = [5000 + x for x in range(100)]
    assert most(nothing + apart) == rules.RESOLUTION and abs(most(shading + [40_000] * 100) - most(shading)) < 100
    assert most(nothing + [5000] * 400) > 5000  # more than a quarter is no junk that stands apart


def test_junk_of_usual_words_is_told_by_its_reason(documents, prose):
    rows = [(i, " ".join(prose(i, 80)), "xx", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "$%" * (k % 3) for k, w in enumerate(prose(i, 80)))[:500], "xx", "s") for i in range(15)]
    rows += [(2000, " ".join(prose(1, 60)) + " $", "xx", "s"), (2001, "short", "xx", "s")]
    got = {r["doc_id"]: r["reason"] for r in rules.judge(documents(rows)).collect()}
    assert {got[i] for i in range(300)} == {None} and {got[1000 + i] for i in range(15)} <= {"symbols", "word_length"}
    assert got[2000] is None and got[2001] == "base"


def test_plan_has_no_python_and_empty_table(documents):
    assert rules.judge(documents([])).collect() == []
    plan = rules.signals(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows_are_judged_alike(documents, prose):
    text = " ".join(prose(1, 90))
    rows = rules.judge(documents([(1, text), (1, text), (None, text)])).collect()
    assert len(rows) == 3 and len({r["kept"] for r in rows}) == 1
