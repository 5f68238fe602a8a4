"""Rates at which documents are used so that their domains meet target weights.

A classifier fitted on the labelled table's documents gives every document a posterior over domains,
its soft membership, in thousandths. Rates depend on the posterior alone, so documents of equal
posteriors are one row, with their tokens, of the least-squares problem: nonnegative rates whose
expected tokens of each domain come closest, relatively, to the targets. Projected gradient steps
solve it: each needs one distributed sum per domain, and a row's rate is folded from the steps so far,
so no rate passes through the driver.

A rate of 1.4 means one copy, and another for 4 of 10 documents, drawn by a hash of the id.

Labelled domains beyond the ``DOMAINS`` most frequent ones share a further class, whose name is null and
whose weight is that of ``None``. A target that no labelled document can serve is an error, not dropped:
the other domains would take its tokens. ``residuals`` says how far each domain is from its target.

Defined cases: a null or empty text has no tokens and the prior as its posterior; a very long text is read
whole; of equal posteriors (ties) the more frequent domain is the likeliest; without labelled documents, or
without tokens, every rate is 1; repeated rows get equal rates; other columns are not read, and ``copies``
passes them on, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.features import BLOCK, BUCKETS, class_counts, collect_counts, features
from reviewmill.llm.joins import small
from reviewmill.llm.resampling import bounded_ids
from reviewmill.llm.words import WordHashes, blocks, returning
from reviewmill.scale import cut_lineage

LABELLED = 50_000
# Domains the classifier tells apart: the most frequent ones of the labelled documents. The others are one more.
DOMAINS = 64
# A document's features count as at most so many independent ones.
EVIDENCE = 32
SMOOTHING = 1 << 12
# Default targets are the domains' own shares to this power, which lifts small domains.
FLATTEN = 0.7
STEPS = 25
CLOSE = 1e-3
# Rows up to which the numbers of copies are sent to every executor.
ROWS = 1_000_000
SEED = 7


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str | None, float] | None = None,
    total: float | None = None,
    least: float = 0.0,
    domain_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = DOMAINS,
) -> DataFrame:
    """doc_id, n_tokens, posterior (thousandths by domain), domain (the likeliest), rate, copies.

    ``targets`` weighs the domains, by default by their shares to the power ``FLATTEN``; ``total`` is the
    tokens to reach, by default the fewest at which no domain is used at a rate below 1. No rate falls
    below ``least``.
    """
    return _solved(docs, labelled, targets, total, least, domain_col, id_col, text_col, most)[0]


def residuals(docs: DataFrame, labelled: DataFrame, *args, **named) -> DataFrame:
    """domain, own, wanted and reached (expected tokens before, by target and after) for ``mix`` of the same arguments."""
    named = {"targets": None, "total": None, "least": 0.0, "domain_col": "lang", "id_col": "doc_id", "text_col": "text", "most": DOMAINS} | named
    named |= dict(zip(named, args, strict=False))
    _, domains, tokens = _solved(docs, labelled, **named)
    rows = [(d, *(float(x) for x in own)) for d, own in zip(domains, np.transpose(tokens), strict=True)]
    return docs.sparkSession.createDataFrame(rows, "domain string, own double, wanted double, reached double")


def _solved(docs, labelled, targets, total, least, domain_col, id_col, text_col, most) -> tuple[DataFrame, list, np.ndarray]:
    """The rows of ``mix``, the domains, and their own, wanted and reached tokens."""
    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(domain_col).cast("string").alias("domain"),
    )
    ids = bounded_ids(labelled, LABELLED)
    marked = source.where("domain IS NOT NULL").select("doc_id", "domain")
    known = docs.sparkSession.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
    counts = marked.join(F.broadcast(known), "doc_id", "left_semi").groupBy("domain").count()
    # At most as many domains as labelled documents.
    domains: list[str | None] = [r["domain"] for r in counts.orderBy(F.desc("count"), "domain").limit(most + 1).collect()]
    if len(domains) > most:
        domains[most] = None
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    if not domains:
        counted = posteriors(source, np.zeros((1, BUCKETS)), np.ones(1))
        empty = counted.select("doc_id", "n_tokens", F.array().cast("array<int>").alias("posterior"))
        empty = empty.select("*", F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
        return empty, [], np.zeros((3, 0))
    weights = _weights(domains, targets)
    scored = cut_lineage(posteriors(source, *fit(source, ids, domains)))
    rate, tokens = fit_rates(scored, len(domains), weights, total, least)
    top = F.array_position("posterior", F.array_max("posterior")).cast("int")
    mixed = (
        scored.withColumn("domain", F.element_at(F.array(*(F.lit(d).cast("string") for d in domains)), top))
        .withColumn("rate", rate)
        .withColumn("copies", F.floor(F.col("rate") + uniform).cast("int"))
    )
    return mixed, domains, tokens


def _weights(domains: list[str | None], targets: dict[str | None, float] | None) -> np.ndarray | None:
    if targets is None:
        return None
    out_of_reach = [d for d, w in targets.items() if w > 0 and d not in domains]
    if out_of_reach:
        raise ValueError(f"targets that no class of labelled documents serves: {out_of_reach}")
    return np.array([max(0.0, targets.get(d, 0.0)) for d in domains])


def fit(docs: DataFrame, ids: np.ndarray, domains: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each bucket in each domain, and the domains' shares."""
    known = docs.sparkSession.sparkContext.broadcast(ids)

    place = {d: i for i, d in enumerate(domains)}
    rest = place.pop(None, -1)

    def label(batch: pa.RecordBatch) -> np.ndarray:
        own = batch.column("doc_id")
        labelled = np.isin(own.fill_null(0).to_numpy(), known.value) & own.is_valid().to_numpy(False)
        cls = [place.get(d, rest) if m and d is not None else -1 for d, m in zip(batch.column("domain").to_pylist(), labelled, strict=True)]
        return np.array(cls, np.int64)

    n = len(domains)
    counts = collect_counts(class_counts(docs, n, label), n)
    overall = (counts[n] + 1) / (counts[n].sum() + BUCKETS)
    own = counts[:n]
    size = own.sum(axis=1, keepdims=True)
    return np.log((own + SMOOTHING * overall) / (size + SMOOTHING)), (size[:, 0] + 1) / (size.sum() + n)


def posteriors(docs: DataFrame, model: np.ndarray, prior: np.ndarray) -> DataFrame:
    """doc_id, n_tokens and posterior of every row; a posterior's thousandths add up to 1000."""
    sent = docs.sparkSession.sparkContext.broadcast((model, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        logs, shares = sent.value
        for batch in batches:
            for start, end, values in blocks(batch, limit=BLOCK):
                row, bucket = features(values, hashes)
                n = np.bincount(row, minlength=len(values))
                sums = np.stack([np.bincount(row, weights=of[bucket], minlength=len(values)) for of in logs])
                logits = sums / np.maximum(n, 1) * np.minimum(n, EVIDENCE) + np.log(shares)[:, None]
                odds = np.exp(logits - logits.max(axis=0))
                parts = np.floor(1000 * odds / odds.sum(axis=0)).astype(np.int32)
                parts[parts.argmax(axis=0), np.arange(len(values))] += 1000 - parts.sum(axis=0, dtype=np.int32)
                ends = np.arange(len(values) + 1, dtype=np.int32) * len(logs)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(parts.T.ravel()))
                ids = batch.column("doc_id").slice(start, end - start)
                yield pa.RecordBatch.from_arrays([ids, pa.array((n + 1) // 2), lists], ["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id bigint, n_tokens bigint, posterior array<int>")


def _dot(vector: np.ndarray) -> Column:
    terms = [F.get("posterior", F.lit(d)) * F.lit(float(v) / 1000) for d, v in enumerate(vector)]
    return sum(terms[1:], terms[0])


def fit_rates(scored: DataFrame, n: int, weights: np.ndarray | None, total: float | None, least: float) -> tuple[Column, np.ndarray]:
    """The rate as an expression of the posterior, and each domain's own, wanted and reached tokens."""
    groups = cut_lineage(scored.groupBy("posterior").agg(F.sum("n_tokens").alias("tokens")))

    def tokens(rate: Column) -> np.ndarray:
        row = groups.agg(*(F.sum(F.col("tokens") * rate * F.get("posterior", F.lit(d)) / 1000) for d in range(n))).first()
        return np.array([v or 0.0 for v in row])

    own = tokens(F.lit(1.0))
    if weights is None:
        weights = own**FLATTEN
    if not own.sum() or not weights.sum():
        return F.lit(1.0), np.array([own, own, own])
    weights = weights / weights.sum()
    if total is None:
        total = (own[weights > 0] / weights[weights > 0]).max()
    wanted = weights * total
    scale = np.maximum(wanted, 1e-3 * total) ** 2
    # The row sums of the normal matrix: steps divided by them cannot overshoot.
    bound = F.greatest(_dot(own / scale), F.lit(1e-300))
    history: list[np.ndarray] = []
    reached, before = own, np.inf
    for _ in range(STEPS):
        residual = (reached - wanted) / np.sqrt(scale)
        distance = float(residual @ residual)
        if np.abs(residual).max() < CLOSE or before - distance < CLOSE * CLOSE:
            break
        history.append((reached - wanted) / scale)
        before = distance
        reached = tokens(_folded(history, bound, least))
    return _folded(history, bound, least), np.array([own, wanted, reached])


def _folded(history: list[np.ndarray], bound: Column, least: float) -> Column:
    """The rate after projected steps along the gradients given, from the rate 1."""
    if not history:
        return F.greatest(F.lit(1.0), F.lit(float(least)))
    gradients = F.array(*(_dot(g) / bound for g in history))
    return F.aggregate(gradients, F.lit(1.0), lambda rate, g: F.greatest(F.lit(float(least)), rate - g))


def copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents, each as often as ``mixed`` (doc_id, copies) says, and once if it says nothing."""
    times = mixed.where("copies <> 1 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_mixed_id"))
    times = small(times.agg(F.max("copies").alias("_mixed_copies")), ROWS)
    joined = docs.join(times, docs[id_col] == times["_mixed_id"], "left")
    count = F.coalesce("_mixed_copies", F.lit(1))
    each = F.explode(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")))
    return joined.withColumn("_mixed_copy", each).select(*(docs[c] for c in docs.columns))
