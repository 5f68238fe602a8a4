import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewmill.config import Config, ThemeConfig, WindowConfig
from reviewmill.operators import themes
from reviewmill.operators.ordering import corpus_position
from reviewmill.operators.payloads import number_batches
from reviewmill.operators.windows import compute_windows, daily_rollup
from reviewmill.plans.weekly import build_themes

WEEK = dt.date(2026, 8, 30)


@pytest.mark.parametrize(
    "count, baseline, expected",
    [(13, 10.0, "rising"), (7, 10.0, "falling"), (10, 10.0, "steady"), (125, 100.0, "rising"), (75, 100.0, "falling"),
     (124, 100.0, "steady"), (76, 100.0, "steady"), (5, 0.0, "rising"), (0, 0.0, "steady")],
)
def test_trend_boundaries(spark, count, baseline, expected):
    row = spark.range(1).select(themes.trend(F.lit(count), F.lit(baseline)).alias("t")).first()
    assert row.t == expected


def stats(spark, rows):
    data = [("p", WEEK, t, n, a) for t, n, a in rows]
    return spark.createDataFrame(data, "product_id string, week_ending date, theme_id string, count_week long, avg_rating_week double")


def test_ranking_ties(spark):
    ranked = themes.rank_themes(stats(spark, [("b", 5, 2.0), ("a", 5, 2.0), ("c", 5, None), ("d", 9, 4.0), ("e", 5, 1.0)]))
    assert [r.theme_id for r in ranked.orderBy("rank").collect()] == ["d", "e", "a", "b", "c"]


def test_top_themes_leave_other_out_only_if_enough_remain(spark):
    ranked = themes.rank_themes(stats(spark, [("other", 9, 1.0), ("a", 5, 2.0), ("b", 4, 2.0), ("c", 3, 2.0)]))
    assert [r.theme_id for r in themes.top_themes(ranked).orderBy("rank").collect()] == ["a", "b", "c"]
    few = themes.rank_themes(stats(spark, [("other", 9, 1.0), ("a", 5, 2.0), ("b", 4, 2.0)]))
    assert [r.theme_id for r in themes.top_themes(few).orderBy("rank").collect()] == ["other", "a", "b"]


def fold(order):
    """Fold the smallest theme into other, one at a time; ``order`` lists themes as first seen."""
    sizes = Counter(order)
    listed = list(dict.fromkeys(order))
    moved = {}
    while len(listed) > 5:
        smallest = min((t for t in listed if t != "other"), key=lambda t: sizes[t])
        sizes["other"] += sizes.pop(smallest)
        moved[smallest] = "other"
        listed = [t for t in listed if t not in (smallest, "other")] + ["other"]
    return moved


def test_merge_to_cap_equals_folding_one_at_a_time(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for product in range(30):
        names = [f"t{i}" for i in range(rng.randint(3, 9))] + rng.choice([[], ["other"]])
        order = [rng.choice(names) for _ in range(rng.randint(5, 25))]
        moved = fold(order)
        for i, theme in enumerate(order):
            rows.append((f"p{product}", f"{product}-{i}", theme, WEEK, 3, (0, i)))
            expected[(f"p{product}", f"{product}-{i}")] = moved.get(theme, theme)
    members = spark.createDataFrame(
        rows, "product_id string, id string, theme_id string, date date, rating int, first_pos struct<batch_no:bigint,pos:int>"
    )
    got = {(r.product_id, r.id): r.theme_id for r in themes.merge_to_cap(members).collect()}
    assert got == expected


def make_reviews(spark, n=60):
    rows = [("p", f"{i:012x}", "play_store", WEEK - dt.timedelta(days=i % 20), 1 + i % 5, "", f"text {i}", None) for i in range(n)]
    return spark.createDataFrame(rows, "product_id string, id string, store string, date date, rating int, title string, text string, app_version string")


def test_unknown_omitted_and_repeated_assignments(spark):
    reviews = make_reviews(spark, 4)
    rows = [("p", f"{0:012x}", "kyc", 0.9, 0, 0), ("p", f"{0:012x}", "payments", 0.8, 1, 0), ("p", f"{1:012x}", "nonsense", 0.7, 0, 1),
            ("p", "not a review", "kyc", 1.0, 0, 2)]
    assigned = spark.createDataFrame(rows, "product_id string, review_id string, theme_id string, confidence double, batch_no bigint, pos int")
    got = [(r.theme_id, r.confidence) for r in themes.reconcile(reviews, assigned).orderBy("id").collect()]
    assert got == [("payments", 0.8), ("other", 0.7), ("other", 0.0), ("other", 0.0)]


def test_split_of_other_gets_its_own_label(spark):
    reviews = make_reviews(spark)
    none = spark.createDataFrame([], "product_id string, review_id string, theme_id string, confidence double, batch_no bigint, pos int")
    windows = compute_windows(daily_rollup(reviews), spark.createDataFrame([("p", WEEK)], "product_id string, week_ending date"))
    proposals = spark.createDataFrame([("p", "App Speed", "Slow app")], "product_id string, new_theme_id string, new_theme_label string")
    moves = reviews.limit(20).select("product_id", F.col("id").alias("review_id"), F.lit("app_speed").alias("theme_id"))
    built = build_themes(reviews, none, windows, proposals=proposals, reassignments=moves)
    got = {r.theme_id: (r.label, r.count_corpus) for r in built.stats.collect()}
    assert got == {"app_speed": ("Slow app", 20), "other": ("Unclassified", 40)}


def test_thin_week_falls_back(spark):
    reviews = make_reviews(spark, 40)  # two a day, so 14 in seven days
    weeks = spark.createDataFrame([("p", WEEK)], "product_id string, week_ending date")
    row = compute_windows(daily_rollup(reviews), weeks).first()
    assert row.window_note == "4-week rollup (low weekly volume)"
    assert (row.review_count_week, row.reporting_from) == (40, WEEK - dt.timedelta(days=27))
    row = compute_windows(daily_rollup(reviews), weeks, WindowConfig(min_week_reviews=14)).first()
    assert (row.window_note, row.review_count_week, row.corpus_from) == (None, 14, WEEK - dt.timedelta(days=28))


def test_positions_follow_date_then_id(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["p", "q", None]), WEEK - dt.timedelta(days=rng.randint(0, 3)), f"{rng.getrandbits(48):012x}") for _ in range(300)]
    got = corpus_position(spark.createDataFrame(rows, "product_id string, date date, id string")).collect()
    for product in ("p", "q", None):
        ordered = sorted((d, i) for p, d, i in rows if p == product)
        assert [(r.date, r.id) for r in sorted((r for r in got if r.product_id == product), key=lambda r: r.pos)] == ordered
        assert {r.pos for r in got if r.product_id == product} == set(range(len(ordered)))


def test_scorer_sees_whole_batches_and_failures_go_to_other(spark):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        assert len(batch) <= 7
        if batch["text"].eq("text 0").any():
            raise RuntimeError("model down")
        return pd.DataFrame({"review_id": batch["review_id"], "theme_id": "kyc", "confidence": 1.0})

    reviews = make_reviews(spark)
    got = {r.review_id: r.theme_id for r in themes.assign_themes(reviews, scorer, 7).collect()}
    batches = {r.id: r.batch_no for r in number_batches(reviews, 7).collect()}
    failed = batches[f"{0:012x}"]
    assert got == {i: "other" if b == failed else "kyc" for i, b in batches.items()}


def test_keyword_ties_go_to_the_earlier_theme(values):
    words = (("a", ("slow", "lag")), ("b", ("crash",)))
    texts = ["Slow and crash", "crash crash slow", "slowly", ""]
    assert values(texts, lambda c: themes.keyword_theme(c, words)) == ["a", "b", "other", "other"]


def test_member_lists_are_chunked(spark):
    members = make_reviews(spark, 25).withColumn("theme_id", F.lit("kyc"))
    chunks = themes.member_lists(members, 10).orderBy("chunk_no").collect()
    assert [len(c.review_ids) for c in chunks] == [10, 10, 5]
    assert Config().themes == ThemeConfig()


def test_weeks_built_together_equal_weeks_built_alone(spark):
    """Themes of one week must not crowd out those of another."""
    early, late = dt.date(2026, 6, 7), dt.date(2026, 8, 30)
    rows = [(i, early - dt.timedelta(days=i % 5), f"t{i % 4}") for i in range(200)]
    rows += [(1000 + i, late - dt.timedelta(days=i % 5), f"t{5 + (i % 18 >= 5) + (i % 18 >= 11)}") for i in range(18)]
    reviews = spark.createDataFrame(
        [("p", f"{i:012x}", "play_store", d, 3, "", f"text {i}", None) for i, d, _ in rows],
        "product_id string, id string, store string, date date, rating int, title string, text string, app_version string",
    )
    assigned = spark.createDataFrame(
        [("p", f"{i:012x}", t, 1.0, 0, i) for i, _, t in rows],
        "product_id string, review_id string, theme_id string, confidence double, batch_no bigint, pos int",
    )
    cfg = Config(themes=ThemeConfig(seeds=tuple((f"t{i}", f"T{i}") for i in range(9))))
    weeks = spark.createDataFrame([("p", early), ("p", late)], "product_id string, week_ending date")

    def built(weeks):
        windows = compute_windows(daily_rollup(reviews), weeks)
        stats = build_themes(reviews, assigned, windows, cfg).stats
        return {(r.week_ending, r.theme_id): r.count_corpus for r in stats.collect()}

    together = built(weeks)
    assert together == built(weeks.limit(1)) | built(weeks.filter(weeks.week_ending == late))
    assert {t: n for (w, t), n in together.items() if w == late} == {"t5": 5, "t6": 6, "t7": 7}


def test_split_is_decided_week_by_week(spark):
    weeks = [WEEK, WEEK - dt.timedelta(days=7 * 10)]
    rows = [("p", f"{w}{i:011x}", "play_store", weeks[w] - dt.timedelta(days=i % 5), 3, "", "t", None) for w in (0, 1) for i in range(30)]
    reviews = spark.createDataFrame(rows, "product_id string, id string, store string, date date, rating int, title string, text string, app_version string")
    known = [("p", r[1], "kyc", 1.0, 0, 0) for r in rows if r[1][0] == "1"]
    assigned = spark.createDataFrame(known, "product_id string, review_id string, theme_id string, confidence double, batch_no bigint, pos int")
    keyed = spark.createDataFrame([("p", w) for w in weeks], "product_id string, week_ending date")
    windows = compute_windows(daily_rollup(reviews), keyed)
    proposals = spark.createDataFrame([("p", "New", "New one")], "product_id string, new_theme_id string, new_theme_label string")
    moves = reviews.select("product_id", F.col("id").alias("review_id"), F.lit("new").alias("theme_id"))
    stats = build_themes(reviews, assigned, windows, proposals=proposals, reassignments=moves).stats
    got = {(r.week_ending, r.theme_id, r.label): r.count_corpus for r in stats.collect()}
    assert got == {(weeks[0], "new", "New one"): 30, (weeks[1], "kyc", "KYC & verification"): 30}


def test_keyword_table_equals_plain_counting(spark):
    random_ = random.Random(4)
    words = ["kyc", "pan", "card", "upi", "pay", "later", "the"]
    phrases = [("a", "kyc", 0), ("a", "PAN card", 0), ("b", "pay later", 1), ("b", "the", 1), ("c", "upi pay later", 2), ("c", "kyc", 2), ("c", "kyc", 2)]
    phrases += [("d", "...", 3), ("d", None, 3), ("e", "never there", 4)]
    rows = [("p", str(i), " ".join(random_.choices(words, k=random_.randint(0, 30))).replace("card", "Card!")) for i in range(120)]
    rows += [("p", "null", None), ("p", "long", "kyc " * 50_000)]
    got = themes.keyword_table_themes(
        spark.createDataFrame(rows, "product_id string, id string, text string"),
        spark.createDataFrame(phrases, "theme_id string, phrase string, place int"),
    ).collect()
    kept = {(t, tuple(p.lower().split())): place for t, p, place in phrases if p and p != "..."}

    def expected(body):
        tokens = (body or "").lower().replace("!", " ").split()
        hits = {}
        for (theme, phrase), place in kept.items():
            n = sum(tuple(tokens[i : i + len(phrase)]) == phrase for i in range(len(tokens)))
            if n:
                hits[theme] = (hits.get(theme, (0, 0))[0] + n, place)
        best = min(((-n, place, theme) for theme, (n, place) in hits.items()), default=(0, 0, "other"))
        return best[2], -best[0]

    assert {r.id: (r.theme_id, r.hits) for r in got} == {i: expected(body) for _, i, body in rows}
    none = spark.createDataFrame([], "theme_id string, phrase string, place int")
    reviews = spark.createDataFrame(rows[:2], "product_id string, id string, text string")
    assert {r.theme_id for r in themes.keyword_table_themes(reviews, none).collect()} == {"other"}
