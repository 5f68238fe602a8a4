"""Language of a text by its letters: trigram weights of each language, summed and compared.

A text is lower-cased and its runs of other characters than letters become one blank; the trigrams
of what is left, blanks at both ends included, fall into ``BUCKETS`` buckets by their code points.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1 << 15
# Fixed by the profiles stored so far: code points are digits in this base.
BASE = 31
# Weights are logarithms in units of 1/1000.
UNIT = 1000
# Characters worked on at a time.
BLOCK = 1 << 20


def normalised(c: Column) -> Column:
    """Letters in lower case, with one blank between words and at both ends; null without a letter."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")
    return F.when(c.rlike(r"\p{L}"), F.concat(F.lit(" "), F.btrim(letters), F.lit(" ")))


def chunks(values: pa.Array) -> Iterator[tuple[int, list[str]]]:
    held, size, start = [], 0, 0
    for i, value in enumerate(values.to_pylist()):
        held.append(value or "")
        size += len(held[-1])
        if size >= BLOCK or i == len(values) - 1:
            yield start, held
            held, size, start = [], 0, i + 1


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every trigram of normalised texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket = ((codes[:-2] * BASE + codes[1:-1]) * BASE + codes[2:]) % BUCKETS
    inside = of[:-2] == of[2:]
    return of[:-2][inside], bucket[inside]


@dataclass(frozen=True)
class Profile:
    """Languages in order, and the weight of each bucket in each of them."""

    languages: tuple[str, ...]
    weights: np.ndarray  # languages x BUCKETS, whole numbers

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of weights of every text in every language, and its number of trigrams."""
        of, bucket = trigrams(texts)
        n = len(texts)
        sums = [np.bincount(of, weights=w[bucket], minlength=n).astype(np.int64) for w in self.weights]
        return np.stack(sums, axis=1) if sums else np.zeros((n, 0), np.int64), np.bincount(of, minlength=n)


def profile_of(counts: dict[str, np.ndarray]) -> Profile:
    """Weights from the number of trigrams of each bucket in texts of each language."""
    languages = tuple(sorted(counts))
    weights = [np.floor(np.log((counts[k] + 1) / (counts[k].sum() + BUCKETS)) * UNIT) for k in languages]
    return Profile(languages, np.array(weights, np.int32).reshape(len(languages), BUCKETS))


GUESS = "lang string, prob double, score bigint, margin bigint, trigrams bigint"


def guess(profile: Profile) -> Callable[[Column], Column]:
    """``struct<lang, prob, score, margin, trigrams>`` of a text; null for a text without letters.

    ``text.is_english`` and ``ingest_reviews`` take it as ``detector``.

    ``lang`` has the highest sum, the first by name of equal ones; ``margin`` is its lead over the second;
    ``prob`` is its share of the likelihoods of all languages. One Arrow batch at a time.
    """
    languages, weights = profile.languages, profile.weights
    if not languages:
        return lambda c: F.lit(None).cast(f"struct<{GUESS.replace(' ', ':').replace(',:', ',')}>")
    fields = [("lang", pa.string()), ("prob", pa.float64()), ("score", pa.int64()), ("margin", pa.int64()), ("trigrams", pa.int64())]

    def run(values: pa.Array) -> pa.Array:
        model = Profile(languages, weights)
        parts = []
        for start, texts in chunks(values):
            sums, n = model.scores(texts)
            best = sums.argmax(axis=1)
            rows = np.arange(len(texts))
            score = sums[rows, best]
            likely = np.exp((sums - score[:, None]) / UNIT)
            others = np.where(np.arange(len(languages))[None, :] == best[:, None], np.iinfo(np.int64).min, sums).max(axis=1)
            margin = score - others if len(languages) > 1 else np.zeros(len(texts), np.int64)
            columns = [np.array(languages, object)[best], 1 / likely.sum(axis=1), score, margin, n]
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
            missing = pa.array([v is None for v in values.slice(start, len(texts)).to_pylist()])
            parts.append(pa.StructArray.from_arrays(arrays, [f for f, _ in fields], mask=missing))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))

    detect = F.arrow_udf(run, GUESS)
    return lambda c: detect(normalised(c))


def table_rows(profile: Profile) -> Sequence[tuple[str, int, int]]:
    return [(k, b, int(w)) for k, row in zip(profile.languages, profile.weights, strict=True) for b, w in enumerate(row)]


# Workers need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
