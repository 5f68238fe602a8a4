"""Quality classifier by importance resampling.

Two generative models of hashed words and word pairs, one of target text and one of the raw corpus,
give each document its importance weight, the ratio of its likelihoods. Both are models of one
language, so a document isn't weighed by how often its language was labelled. Documents are then drawn
without replacement in proportion to a power of their weights by Gumbel top-k: a random Gumbel number,
fixed by the document's id, is added to the log weight, and the k largest sums stay.

The target model learns from at most ``LABELLED`` documents labelled good, the first by a hash of
their ids; the raw model and the weights cover every document. Smoothing is a share of the target
model's size, and each bucket's log ratio counts as far as its counts are evidence of a difference.
Texts fall into ``FOLDS`` folds by a hash of the text, and a text is weighed by models of the other folds,
so no text, labelled or not, and no copy of it counts for itself: equal texts have equal weights.

A log weight is compared with those of the labelled documents of its language and length: the bound is
their lower quartile less ``REACH`` interquartile ranges, in units of the root of the length, and at
least ``ODDS`` below 0. Lengths are classes of powers of two; a class of fewer than ``LEAST_LABELLED``
labelled documents takes the bound of its language, a language of fewer that of all. The draw goes by
the distance from the bound.

Defined cases: a null or empty text has the weight 1 (log 0); without any labelled document every
weight is 1 and all documents stay, and so do those of a language without one; null languages are a
language, and those beyond the ``LANGUAGES`` - 1 most frequent share one model; a null id draws like any
other and keeps its row; repeated rows share their draw. Other columns are not read; a table without
the language column is of one language; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.features import BLOCK, BUCKETS, class_counts, collect_counts, features
from reviewmill.llm.selection import largest
from reviewmill.llm.words import WordHashes, blocks, returning
from reviewmill.scale import cut_lineage

LABELLED = 50_000
# Smoothing, as a share of the occurrences the target model holds.
SMOOTHING = 1e-5
# Squared standard errors from equal odds at which a bucket's log ratio counts a quarter.
EVIDENCE = 16.0
# Interquartile ranges between the lower quartile of the labelled documents and the bound.
REACH = 2.0
# The log of odds against the target below which no document is rejected.
ODDS = 1.0
LEAST_LABELLED = 20
LANGUAGES = 64
FOLDS = 4
# The power of the weights is 1 / TEMPERATURE.
TEMPERATURE = 1.0
SEED = 42


def bounded_ids(labelled: DataFrame, limit: int) -> np.ndarray:
    """At most ``limit`` ids of a table with doc_id, the first by a hash of the id, ascending."""
    ids = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    rows = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toPandas()
    return np.sort(rows["doc_id"].to_numpy(np.int64))


def languages(docs: DataFrame) -> list[str | None]:
    """The values of lang that have a model of their own; the others share one."""
    rows = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES - 1)
    return [r["lang"] for r in rows.collect()]


def fit(docs: DataFrame, target: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts of the target documents and of all outside of each fold, by language and fold.

    ``docs`` has doc_id, text, the place of lang and the fold; row lang * FOLDS + fold is a model's.
    """
    known = docs.sparkSession.sparkContext.broadcast(target)
    cells = n_langs * FOLDS

    def label(batch: pa.RecordBatch) -> np.ndarray:
        cell = batch.column("lang").to_numpy() * FOLDS + batch.column("fold").to_numpy()
        return 2 * cell + ~_among(batch.column("doc_id"), known.value)

    counts = collect_counts(class_counts(docs, 2 * cells, label), 2 * cells)[:-1]
    good, other = (counts[i::2].reshape(n_langs, FOLDS, BUCKETS) for i in (0, 1))
    outside = [(x.sum(axis=1, keepdims=True) - x).reshape(cells, BUCKETS) for x in (good, good + other)]
    return outside[0], outside[1]


def _among(ids: pa.Array, known: np.ndarray) -> np.ndarray:
    return np.isin(ids.fill_null(0).to_numpy(), known) & ids.is_valid().to_numpy(False)


def weights(docs: DataFrame, target: np.ndarray, wanted: np.ndarray, raw: np.ndarray) -> DataFrame:
    """doc_id, lang, labelled, n_features and log_weight of every row, under the models of the other folds."""
    model = docs.sparkSession.sparkContext.broadcast((target, wanted, raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        ids, good, every = model.value
        size = good.sum(axis=1)
        shares = size / np.maximum(every.sum(axis=1), 1)
        for batch in batches:
            member = _among(batch.column("doc_id"), ids)
            models = batch.column("lang").to_numpy() * FOLDS + batch.column("fold").to_numpy()
            for start, end, values in blocks(batch, limit=BLOCK):
                row, bucket = features(values, hashes)
                cells, own = np.unique(row * BUCKETS + bucket, return_counts=True)
                row, bucket = cells // BUCKETS, cells % BUCKETS
                at = models[start:end][row]
                share, smooth = shares[at], SMOOTHING * np.maximum(size[at], 1)
                seen, expected = good[at, bucket], every[at, bucket] * share
                # 0.5 stands for the spread of counts near 0.
                errors = (seen - expected) ** 2 / (expected * (1 - share) + 0.5)
                ratio = np.log((seen + smooth) / (expected + smooth)) * (errors / (errors + EVIDENCE)) ** 2
                sums = np.bincount(row, weights=own * ratio, minlength=len(values)).astype(float)
                counts = np.bincount(row, weights=own, minlength=len(values)).astype(np.int64)
                columns = [batch.column(c).slice(start, end - start) for c in ("doc_id", "lang")]
                columns += [pa.array(member[start:end]), pa.array(counts), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "labelled", "n_features", "log_weight"])

    return docs.mapInArrow(returning(run), "doc_id bigint, lang int, labelled boolean, n_features bigint, log_weight double")


def above_bound(scored: DataFrame) -> DataFrame:
    """The rows with ``above``: how far the log weight lies above the bound of its language and length."""
    root = F.sqrt(F.col("n_features").cast("double"))
    length = F.length(F.bin("n_features"))
    units = scored.where("labelled AND n_features > 0").select("lang", length.alias("length"), (F.col("log_weight") / root).alias("u"))
    quartiles = F.percentile("u", F.array(F.lit(0.25), F.lit(0.75))).alias("q")
    known = units.rollup("lang", "length").agg(quartiles, F.count("*").alias("n")).where("n > 0").collect()
    fence = {(r["lang"], r["length"]): r["q"][0] - REACH * (r["q"][1] - r["q"][0]) for r in known}
    bounds = {(r["lang"], r["length"]): fence[r["lang"], r["length"]] for r in known if r["n"] >= LEAST_LABELLED or r["lang"] is None}
    # At most LANGUAGES times 64 rows.
    rows = [
        (lang, size, bounds.get((lang, size), bounds.get((lang, None), bounds.get((None, None)))))
        for lang in sorted({r["lang"] for r in known if r["lang"] is not None})
        for size in range(1, 65)
    ]
    table = scored.sparkSession.createDataFrame(rows, "lang int, length int, bound double")
    joined = scored.withColumn("length", length).join(F.broadcast(table), ["lang", "length"], "left")
    bound = F.least(F.coalesce("bound", F.lit(0.0)) * root, F.lit(-ODDS))
    return joined.withColumn("above", F.col("log_weight") - bound)


def resample(
    docs: DataFrame,
    labelled: DataFrame,
    k: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, n_features, log_weight, key and kept of every row.

    Without ``k`` as many documents are drawn as lie on or above their bounds. ``key`` is the perturbed
    distance of the log weight from its bound in units of 2**-20; the k largest are kept.
    """
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    target = bounded_ids(labelled, LABELLED)
    known = languages(source)
    place = F.lit(len(known))
    for i, name in enumerate(known):
        place = F.when(F.col("lang").eqNullSafe(F.lit(name)), i).otherwise(place)
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    source = source.withColumns({"lang": place.cast("int"), "fold": fold})
    wanted, raw = fit(source, target, len(known) + 1)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gumbel = -F.log(-F.log(uniform))
    scored = (
        above_bound(cut_lineage(weights(source, target, wanted, raw)))
        .withColumn("key", F.floor((F.col("above") / temperature + gumbel) * (1 << 20)).cast("bigint"))
        .withColumn("tie", F.xxhash64("doc_id", "log_weight", F.lit(seed + 1)))
    )
    if k is None:
        k = scored.where("above >= 0").count()
    drawn = scored.withColumn("kept", largest(scored, k, ["key", "tie"]))
    return drawn.select("doc_id", "n_features", "log_weight", "key", "kept")
