import datetime as dt
import random
from difflib import SequenceMatcher

import pytest

from reviewmill.config import NoteConfig
from reviewmill.operators.quotes import quotable, quote_pool, rank_quotes

DAY = dt.date(2026, 8, 30)
SCHEMA = (
    "product_id string, week_ending date, theme_id string, id string, date date, rating int, text string, distance double"
)


def brute_force(rows, threshold, limit):
    """One theme, in order: keep a row unless it is too close to a kept one."""
    kept = []
    for row in sorted(rows, key=lambda r: (r[7], r[3])):
        if len(kept) == limit:
            break
        ratios = (SequenceMatcher(None, row[6].lower(), k[6].lower()).ratio() for k in kept)
        if all(r < threshold for r in ratios):
            kept.append(row)
    return [r[3] for r in kept]


def make_rows(seed):
    rng = random.Random(seed)
    words = "app crash login slow payment failed refund support chart bank never again today update".split()
    base = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)]
    rows = []
    for theme, count in (("hot", 260), ("small", 5), ("mixed", 60)):
        for i in range(count):
            if theme == "mixed":
                body = " ".join(rng.choice(words) for _ in range(rng.randint(7, 20)))
            else:
                body = base[min(i // 40, 5)]
                if rng.random() < 0.5:  # a near copy
                    at = rng.randrange(len(body))
                    body = body[:at] + rng.choice("xyz") + body[at + 1 :]
            rows.append(("p", DAY, theme, f"{seed}{theme}{i:04d}", DAY, rng.choice([1, 2, 5, None]), body, float(i // 50)))
    return rows


@pytest.mark.parametrize("front", [3, 16, 256])
def test_pool_equals_brute_force_whatever_the_front(spark, front):
    """A theme of near copies needs several rounds with a short front."""
    cfg = NoteConfig(max_candidates=4)
    rows = make_rows(front)
    pool = quote_pool(spark.createDataFrame(rows, SCHEMA), cfg, front=front).orderBy("theme_id", "rank").collect()
    for theme in ("hot", "small", "mixed"):
        expected = brute_force([r for r in rows if r[2] == theme], cfg.similarity, cfg.max_candidates)
        assert [r.id for r in pool if r.theme_id == theme] == expected
    assert all(r.rank >= 1 for r in pool)


def test_ranking_prefers_typical_ratings_then_id(spark):
    rows = [("p", DAY, "t", i, DAY, 3, "x", d) for i, d in (("b", 1.0), ("a", 1.0), ("c", 0.5))]
    ranked = rank_quotes(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [r.id for r in ranked] == ["c", "a", "b"]


def test_quotable_bounds_and_markers(values):
    texts = ["x" * 39, "x" * 40, " " + "x" * 200 + " ", "x" * 201, "call me at [Phone] about this matter, it is urgent"]
    assert values(texts, quotable) == [False, True, True, False, False]
