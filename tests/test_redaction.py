import random

from pyspark.sql import functions as F

from reviewmill.functions import pii
from reviewmill.operators.redaction import redact_reviews, redaction_report, scan_pii

CASES = {
    "Reach me at user@example.com about INR 500.": "Reach me at [email] about INR 500.",
    "Please call +91 98765 43210 today.": "Please call [phone] today.",
    "Follow up via @angry_user on this.": "Follow up via [handle] on this.",
    "See https://example.com/u/jane?x=1 or WWW.x.y now": "See [link] or [link] now",
    "device ABCDEF123456 broke": "device [id] broke",
    "account 12345678": "account [phone]",
    "x12345678y": "x[id]y",
    "Froze again. - Jane D.": "Froze again. [name]",
    "Froze again.\n- Jane Doe\nbye": "Froze again. [name]\nbye",
    "paid ₹1,500.50 on v3.4.1, 4.2 and 5 stars": "paid ₹1,500.50 on v3.4.1, 4.2 and 5 stars",
    "gave 5 stars 98765432": "gave 5 stars 98765432",
    "4.5₹ 12345678": "4.5₹ 12345678",
    "on 2026-08-30 it broke": "on [phone] it broke",
    "keep __KEEP_0__ and 4.2 please": "keep __KEEP_0__ and 4.2 please",
    "  nothing here  ": "nothing here",
    "": "",
}


def test_each_kind_of_personal_data(values):
    assert values(list(CASES), lambda c: pii.redact(c)["text"]) == list(CASES.values())


def test_null_stays_null(values):
    assert values([None], lambda c: pii.redact(c)["text"]) == [None]


def test_counts_and_report(spark):
    rows = spark.createDataFrame(
        [("p", "a@b.io", "call 98765 43210 or a@b.io"), ("p", "fine", "all good"), ("q", "ok", "see www.a.b")],
        "product_id string, title string, text string",
    )
    out = {r.product_id: r for r in redaction_report(redact_reviews(rows)).collect()}
    assert (out["p"].reviews_in, out["p"].reviews_out, out["p"].fields_touched) == (2, 2, 1)
    assert out["p"].replacements["email"] == 2 and out["p"].replacements["phone"] == 1
    assert out["q"].replacements["link"] == 1


def test_scan_reports_categories_only(spark):
    rows = spark.createDataFrame(
        [(1, "mail a@b.io, 98765 43210"), (2, "paid ₹500 on 2026-08-30, 24–30 Aug, 1,042 reviews, v3.4.1"), (3, "[email] [id]")],
        "i int, md string",
    )
    hits = {r.i: [(h.category, h.hits) for h in r.pii_hits] for r in scan_pii(rows, "md").collect()}
    assert hits == {1: [("email", 1), ("phone", 1)], 2: [], 3: []}


def test_filter_on_redacted_text_plans_quickly(spark):
    rows = spark.range(5).select(F.concat(F.lit("call 98765 4321"), "id").alias("text"))
    clean = redact_reviews(rows, ["text"]).filter(F.col("text").contains("[phone]"))
    assert clean.count() == 5


def _rules(body):
    """The rules one after the other, in plain Python."""
    import regex

    from reviewmill.functions.text import BLANKS

    def compiled(pattern):
        return regex.compile(pattern.replace("(?iu)", "(?i)").replace("(?md)", "(?m)"), regex.V0)

    counts = dict.fromkeys(pii.CATEGORIES, 0)
    spans = []

    def keep(match):
        spans.append(match[0])
        return f"__KEEP_{len(spans) - 1}__"

    if regex.search(r"\p{Nd}", body):
        body = compiled(pii.PROTECTED).sub(keep, body)
    for category, pattern, replacement in pii.REPLACEMENTS:
        body, n = compiled(pattern).subn(replacement, body)
        counts[category] += n
    if spans:
        body = regex.sub(r"__KEEP_(\d+)__", lambda m: spans[int(m[1])] if int(m[1]) < len(spans) else "", body)
    return body.strip(BLANKS), *counts.values()


def test_redaction_equals_rules_in_python(values):
    """Random texts of awkward pieces: ASCII, beyond it, and holding the characters used as marks."""
    pieces = ["a", "Z", "5", "12", "123456789", " ", "\n", "- ", "@", "@abc", ".", "www.", "http://", "x@y.co", "INR ", "Rs. 5", "stars"]
    pieces += ["5 stars", "v1.2", "1.2.3", "__KEEP_0__", "(", "+", "[link]", "ab12cd34ef56gh", "- John", "- Ann B.", "_", "'", "2024-01-02"]
    wide = ["é", "₹", "\u0967\u0968", "ß", "\xa0", "–"]
    random_ = random.Random(11)
    items = []
    for i in range(1500):
        pool = pieces + (wide if i % 3 == 0 else []) + (["\ufdd0", "\ufdd3"] if i % 9 == 0 else [])
        items.append("".join(random_.choice(pool) for _ in range(random_.randint(0, 12))))
    got = [tuple(r) for r in values(items, pii.redact)]
    assert got == [_rules(t) for t in items]
