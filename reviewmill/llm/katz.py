"""Katz backoff language model of a corpus, and the log probability of each of its texts.

A text's tokens are its words, A-Z in lower case, and one end. With c the training counts, N tokens
and Good-Turing factors d (1 from ``LARGE`` + 1 occurrences on),

    p(w)   = d(c(w)) c(w) / (N + 1)                 and what is left for all unknown words
    p(w|h) = d(c(hw)) c(hw) / (c(h) + 1)            if hw was seen
           = a(h) p(w)                              if not; p(w) where h was never seen
    a(h)   = (1 - sum of the seen p(w|h)) / (1 - sum of p(w) over the words seen after h)

so every distribution adds up to one; the one in c(h) + 1 keeps something for unseen words even after
a history whose counts are all large.

*Tables.* Texts are cut into blocks, and a block's distinct words and word pairs travel as packed
arrays, one row per block and bucket: words to the bucket of the word, whose rows number and count
them and go back to their blocks; pairs to the bucket of their history, whose rows hold the pair
counts and the histories' backoff terms, and score the pairs of all blocks. Discounts follow from
counts of counts, which are six numbers per table. A history with many occurrences is dealt by its
next words over several buckets, and its backoff terms are added up over them.

Defined cases: a null or empty text is its end alone; a null id counts as the empty text when
training texts are told from others; repeated rows count as often as they occur; without training
texts all words are unknown; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.words import WordHashes, blocks, mix, offsets
from reviewmill.scale import ensure_checkpoint_dir

LARGE = 5
BLOCK_BYTES = 9 << 20
# Bytes of text for each bucket of the tables.
BUCKET_BYTES = 10 << 20
END = 0x5BD1E995A5A5A5A5


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes first, then all second ones, and so on."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def pack_steps(values: np.ndarray) -> bytes:
    """``pack`` of the steps between numbers, which are small where these are sorted."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_steps(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def inverse(order: np.ndarray) -> np.ndarray:
    """Where each number stands in a permutation."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written once into the shared folder of checkpoints."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/katz-{uuid.uuid4().hex}"
    rows.write.option("compression", "uncompressed").parquet(path)
    return spark.read.parquet(path)


def good_turing(counts: list[int]) -> np.ndarray:
    """Katz's factors of counts 0 to ``LARGE``, from the numbers of types seen 1 to ``LARGE`` + 1 times.

    Where those are too uneven for factors between 0 and 1, a power law is fitted to them first, which
    gives such factors if it falls faster than 1 / r; failing that, they are r / (r + 1/2).
    """
    n = np.array(counts, float)
    r = np.arange(1, LARGE + 1)
    plain = np.concatenate([[0.0], r / (r + 0.5)])
    if (n <= 0).any():
        return plain
    slope = np.polyfit(np.log(np.arange(1, LARGE + 2)), np.log(n), 1)[0]
    for often in (n, np.arange(1.0, LARGE + 2) ** slope):
        last = (LARGE + 1) * often[LARGE] / often[0]
        if last < 1:
            factors = ((r + 1) * often[1:] / (r * often[:-1]) - last) / (1 - last)
            if ((factors > 0) & (factors < 1)).all():
                return np.concatenate([[0.0], factors])
    return plain


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LARGE, factors[np.minimum(counts, LARGE)], 1.0)


def _row(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([columns.get(c)], t) for c, t in types.items()], list(types))


LONGS, INTS, FLOATS = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64())


def _frequent(often: np.ndarray) -> np.ndarray:
    """A block's words from the most frequent on, by which its tokens are numbered: most numbers are small."""
    return np.argsort(-often, kind="stable")


def token_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """One row per block of texts: ids, train, lengths, and its words and tokens as packed arrays."""
    types = {"block": pa.int64(), "ids": LONGS, "train": pa.list_(pa.bool_()), "n": INTS, "held": INTS, "bounds": INTS}
    types |= dict.fromkeys(("words", "counts", "often", "tokens"), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            for start, end, values in blocks(batch, limit=BLOCK_BYTES):
                lists = [(v or b"").lower().split() for v in values]
                n = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
                flat = np.full(n.sum(), END, np.uint64)
                inner = np.ones(len(flat), bool)
                inner[np.cumsum(n) - 1] = False
                flat[inner] = hashes.of([w for words in lists for w in words])
                words, tokens = np.unique(flat, return_inverse=True)
                bucket = (mix(words) >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                tokens = inverse(order)[tokens]
                held, bounds = np.unique(bucket[order], return_index=True)
                taught = np.repeat(np.array(train[start:end], bool), n)
                counts = np.bincount(tokens[taught], minlength=len(words))
                often = np.bincount(tokens, minlength=len(words))
                yield _row(
                    {
                        "block": number,
                        "ids": ids[start:end],
                        "train": train[start:end],
                        "n": n,
                        "held": held.astype(np.int64),
                        "bounds": np.append(bounds, len(words)),
                        "words": pack_steps(words[order]),
                        "counts": pack(counts.astype(np.int32)),
                        "often": pack(often.astype(np.int32)),
                        "tokens": pack(inverse(_frequent(often))[tokens].astype(np.int32)),
                    },
                    types,
                )
                number += 1

    return docs.mapInArrow(
        run,
        "block bigint, ids array<bigint>, train array<boolean>, n array<int>, held array<int>, "
        "bounds array<int>, words binary, counts binary, often binary, tokens binary",
    )


def count_words(tokens: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket, the words' numbers (rank within the bucket) and, by rank, counts; per bucket, block -1, sums."""
    dealt_types = {"bucket": pa.int32(), "block": pa.int64(), "words": pa.binary(), "counts": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpack_steps(row["words"], np.uint64), unpack(row["counts"], np.int32)
                for b, low, high in zip(row["held"], row["bounds"][:-1], row["bounds"][1:], strict=True):
                    packed = {"words": pack_steps(words[low:high]), "counts": pack(counts[low:high])}
                    yield _row({"bucket": b, "block": row["block"]} | packed, dealt_types)

    types = {"block": pa.int64(), "bucket": pa.int32(), "ranks": pa.binary(), "c": pa.binary(), "sums": LONGS}

    def count(rows: pa.Table) -> pa.Table:
        parts = rows.to_pylist()
        words = [unpack_steps(p["words"], np.uint64) for p in parts]
        counts = np.concatenate([unpack(p["counts"], np.int32) for p in parts])
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)
        rank = inverse(np.lexsort((known, -total)))
        bucket, ends = parts[0]["bucket"], offsets(np.array([len(w) for w in words]))
        out = []
        for p, low, high in zip(parts, ends[:-1], ends[1:], strict=True):
            ranks, c = rank[place[low:high]], total[place[low:high]]
            packed = {"ranks": pack(ranks), "c": pack_steps(c[np.argsort(ranks)])}
            out.append(_row({"block": p["block"], "bucket": bucket} | packed, types))
        often = np.bincount(np.minimum(total, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2]
        out.append(_row({"block": -1, "bucket": bucket, "sums": [total.sum(), (total > 0).sum(), *often]}, types))
        return pa.Table.from_batches(out)

    dealt = tokens.select("block", "held", "bounds", "words", "counts").mapInArrow(
        deal, "bucket int, block bigint, words binary, counts binary"
    )
    return dealt.groupBy("bucket").applyInArrow(
        count, "block bigint, bucket int, ranks binary, c binary, sums array<bigint>"
    )


class _Unigrams:
    """Sums over the word table, and the log10 probabilities that follow."""

    def __init__(self, sums: list[int], docs: int, buckets: int) -> None:
        self.tokens, self.types, *often = sums
        self.factors = good_turing(often)
        self.docs, self.buckets = docs, buckets
        self.left = 1 + float(np.dot((1 - self.factors[1:]) * np.arange(1, LARGE + 1), often[:LARGE]))

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.factors), self.left) / (self.tokens + 1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def shares(self, c: np.ndarray) -> np.ndarray:
        """Over how many buckets a history of c occurrences is dealt."""
        return np.maximum(1, np.ceil(c * (2.0 * self.buckets) / max(1, self.tokens))).astype(np.int64)


PAIR_TYPES = {"bucket": pa.int32(), "block": pa.int64()}
PAIR_TYPES |= dict.fromkeys(("h", "ch", "spans", "words", "cw", "w", "seen", "runs", "docs"), pa.binary())
PAIR_TYPES |= {"ids": LONGS, "train": pa.list_(pa.bool_()), "n": INTS, "known": INTS, "base": FLOATS, "own": FLOATS}
INFO = ("ids", "train", "n", "known", "base", "own")
INFO_SCHEMA = "ids array<bigint>, train array<boolean>, n array<int>, known array<int>, base array<double>, own array<double>"


def word_pairs(tokens: DataFrame, words: DataFrame, parts: dict) -> DataFrame:
    """Per block and bucket of histories, the distinct pairs and the texts they stand in; per block, its texts.

    A row holds each of its histories once, with its count and its number of pairs, and each next word
    once, with its count; pairs are sorted and name their next words by place.
    """

    def pairs(block: pa.Table, numbers: pa.Table) -> pa.Table:
        model = _Unigrams.__new__(_Unigrams)
        model.__dict__.update(parts)
        empty = pa.Table.from_batches([], pa.schema(list(PAIR_TYPES.items())))
        if not len(block) or not len(numbers):
            return empty
        row = block.to_pylist()[0]
        size = row["bounds"][-1]
        number, c = np.zeros(size, np.int64), np.zeros(size, np.int64)
        bounds = dict(zip(row["held"], zip(row["bounds"][:-1], row["bounds"][1:], strict=True), strict=True))
        for r in numbers.to_pylist():
            at = slice(*bounds[r["bucket"]])
            ranks = unpack(r["ranks"], np.int64)
            number[at] = ranks * model.buckets + r["bucket"] + 1
            c[at] = unpack_steps(r["c"], np.int64)[inverse(np.argsort(ranks))]
        order = np.argsort(number)
        number, c = number[order], c[order]
        token = inverse(order)[_frequent(unpack(row["often"], np.int32))][unpack(row["tokens"], np.int32)]
        n = np.array(row["n"], np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, weights=model.base(c)[token], minlength=len(n))
        known = np.bincount(doc, weights=c[token] > 0, minlength=len(n))
        first = np.zeros(len(token), bool)
        first[offsets(n)[:-1]] = True
        # The history of a text's first token is its start, of number 0, after the words.
        number, c = np.append(number, 0), np.append(c, model.docs)
        history = np.where(first, size, np.concatenate([[size], token[:-1]]))
        backed = c[history] == 0
        own = np.bincount(doc, weights=backed * np.log10(model.probability(c))[token], minlength=len(n))
        taught = np.repeat(np.array(row["train"], bool), n)
        key = history * np.int64(size + 1) + token
        key, doc, taught = key[~backed], doc[~backed], taught[~backed]
        pair, place = np.unique(key, return_inverse=True)
        h, w = pair // (size + 1), pair % (size + 1)
        shares = model.shares(c[h])
        dealt = mix(number[h].astype(np.uint64)) + mix(number[w].astype(np.uint64)) % shares.astype(np.uint64)
        bucket = (dealt % np.uint64(model.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = inverse(order)[place]
        h, w, bucket = h[order], w[order], bucket[order]
        seen = np.bincount(place, weights=taught, minlength=len(pair)).astype(np.int32)
        runs = np.bincount(place, minlength=len(pair))
        doc = doc[np.argsort(place, kind="stable")]
        held, lows = np.unique(bucket, return_index=True)
        ends = offsets(runs)
        info = {"ids": row["ids"], "train": row["train"], "n": n, "known": known.astype(int), "base": base, "own": own}
        out = [_row({"bucket": row["block"] % model.buckets, "block": row["block"]} | info, PAIR_TYPES)]
        for b, low, high in zip(held, lows, np.append(lows, len(bucket))[1:], strict=True):
            histories, spans = np.unique(h[low:high], return_counts=True)
            following, at = np.unique(w[low:high], return_inverse=True)
            packed = {
                "h": pack_steps(number[histories]),
                "ch": pack_steps(c[histories]),
                "spans": pack(spans.astype(np.int32)),
                "words": pack_steps(number[following]),
                "cw": pack_steps(c[following]),
                "w": pack(at.astype(np.int32)),
                "seen": pack(seen[low:high]),
                "runs": pack(runs[low:high].astype(np.int32)),
                "docs": pack(doc[ends[low] : ends[high]].astype(np.int32)),
            }
            out.append(_row({"bucket": int(b), "block": row["block"]} | packed, PAIR_TYPES))
        return pa.Table.from_batches(out)

    left = tokens.drop("words", "counts")
    schema = (
        "bucket int, block bigint, h binary, ch binary, spans binary, words binary, cw binary, w binary, "
        "seen binary, runs binary, docs binary, "
    )
    return left.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(pairs, schema + INFO_SCHEMA)


SCORE_TYPES = {"block": pa.int64(), "docs": pa.binary(), "sums": pa.binary(), "classes": pa.binary()}
SCORE_TYPES |= {"often": LONGS, "histories": pa.binary(), "ch": pa.binary(), "small": pa.binary(), "lower": pa.binary()}
SCORE_TYPES |= {"spread": pa.binary(), "u_block": pa.binary(), "u_doc": pa.binary(), "u_at": pa.binary()}
SCORE_TYPES |= {c: PAIR_TYPES[c] for c in INFO}
SCORE_SCHEMA = (
    "block bigint, docs binary, sums binary, classes binary, often array<bigint>, histories binary, ch binary, "
    "small binary, lower binary, spread binary, u_block binary, u_doc binary, u_at binary, " + INFO_SCHEMA
)


def score_pairs(pairs: DataFrame, parts: dict) -> DataFrame:
    """Per bucket: the texts' sums over seen pairs, by block, but for the discounts; the histories' terms."""

    def score(rows: pa.Table) -> pa.Table:
        model = _Unigrams.__new__(_Unigrams)
        model.__dict__.update(parts)
        every = rows.to_pylist()
        out = [_row({"block": r["block"]} | {c: r[c] for c in INFO}, SCORE_TYPES) for r in every if r["h"] is None]
        every = [r for r in every if r["h"] is not None]
        if not every:
            return pa.Table.from_batches(out)

        def of_histories(name: str) -> np.ndarray:
            return np.concatenate([np.repeat(unpack_steps(r[name], np.int64), unpack(r["spans"], np.int32)) for r in every])

        def of_words(name: str) -> np.ndarray:
            return np.concatenate([unpack_steps(r[name], np.int64)[unpack(r["w"], np.int32)] for r in every])

        ch, cw = of_histories("ch"), of_words("cw")
        history, at = np.unique(of_histories("h"), return_inverse=True)
        pair, first, place = np.unique(at.astype(np.int64) << 36 | of_words("words"), return_index=True, return_inverse=True)
        seen = np.concatenate([unpack(r["seen"], np.int32) for r in every])
        total = np.bincount(place, weights=seen).astype(np.int64)
        often = np.bincount(np.minimum(total, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2]
        of, lower_p = at[first], model.probability(cw[first])
        lower = np.bincount(of, weights=lower_p * (total > 0), minlength=len(history))
        small = np.zeros((len(history), LARGE), np.int64)
        low = (total > 0) & (total <= LARGE)
        np.add.at(small, (of[low], total[low] - 1), 1)
        count = total[place]
        term = np.where(count > 0, np.log10(np.maximum(count, 1)) - np.log10(ch + 1), np.log10(model.probability(cw)))
        kind = np.where(count <= LARGE, count, LARGE + 1).astype(np.int64)
        runs = [unpack(r["runs"], np.int32) for r in every]
        types = offsets(np.array([len(r) for r in runs]))
        u_block, u_doc, u_at = [], [], []
        for r, own, begin, end in zip(every, runs, types[:-1], types[1:], strict=True):
            doc = unpack(r["docs"], np.int32)
            size = int(doc.max()) + 1
            terms, kinds = np.repeat(term[begin:end], own), np.repeat(kind[begin:end], own)
            sums = np.bincount(doc, weights=terms, minlength=size)
            classes = np.bincount(doc * (LARGE + 2) + kinds, minlength=size * (LARGE + 2)).reshape(size, LARGE + 2)
            there = np.flatnonzero(classes.any(axis=1))
            packed = {"docs": pack(there.astype(np.int32)), "sums": pack(sums[there])}
            packed["classes"] = pack(classes[there, 1 : LARGE + 1].astype(np.int32).ravel())
            out.append(_row({"block": r["block"]} | packed, SCORE_TYPES))
            unseen = kinds == 0
            u_doc.append(doc[unseen])
            u_at.append(np.repeat(at[begin:end], own)[unseen])
            u_block.append(np.full(int(unseen.sum()), r["block"], np.int64))
        ch_of = np.zeros(len(history), np.int64)
        ch_of[at] = ch
        u_at = np.concatenate(u_at)
        shares = model.shares(ch_of)
        needed = shares > 1
        needed[u_at] = True
        index = np.cumsum(needed) - 1
        terms = {
            "often": often,
            "histories": pack(history[needed]),
            "ch": pack(ch_of[needed]),
            "small": pack(small[needed].ravel()),
            "lower": pack(lower[needed]),
            "spread": pack((shares[needed] > 1).astype(np.int32)),
            "u_block": pack(np.concatenate(u_block)),
            "u_doc": pack(np.concatenate(u_doc)),
            "u_at": pack(index[u_at].astype(np.int32)),
        }
        out.append(_row({"block": -1} | terms, SCORE_TYPES))
        return pa.Table.from_batches(out)

    return pairs.groupBy("bucket").applyInArrow(score, SCORE_SCHEMA)


def backoff(ch: np.ndarray, small: np.ndarray, lower: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """a(h) of histories: their counts, numbers of pairs seen 1 to ``LARGE`` times, and lower-order masses."""
    left = 1 + (small * ((1 - factors[1:]) * np.arange(1, LARGE + 1))).sum(axis=1)
    return left / (ch + 1) / np.maximum(1 - lower, 1e-12)


def _spread_terms(rows: DataFrame) -> dict[str, np.ndarray]:
    """The added-up terms of histories dealt over several buckets, fewer than four per bucket."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                wide = unpack(r["spread"], np.int32) > 0
                small = unpack(r["small"], np.int64).reshape(-1, LARGE)[wide]
                columns = [unpack(r["histories"], np.int64)[wide], *small.T, unpack(r["lower"], np.float64)[wide]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    counts = [f"n{r}" for r in range(1, LARGE + 1)]
    names = ["h", *counts, "lower"]
    schema = "h bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", lower double"
    found = rows.where("block = -1").select("histories", "small", "lower", "spread").mapInArrow(spread, schema)
    table = found.groupBy("h").agg(*(F.sum(c).alias(c) for c in names[1:])).orderBy("h").toPandas()
    return {"h": table["h"].to_numpy(np.int64), "small": table[counts].to_numpy(float), "lower": table["lower"].to_numpy(float)}


def _finish(rows: DataFrame, parts: dict, factors: np.ndarray, wide: dict[str, np.ndarray]) -> DataFrame:
    """Texts' scores: sums by block of what the buckets found, with discounts and backoff weights."""
    part_types = {"block": pa.int64(), "docs": pa.binary(), "sums": pa.binary()} | {c: PAIR_TYPES[c] for c in INFO}
    log_factors = np.log10(np.maximum(factors[1:], 1e-300))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["ids"] is not None:
                    yield _row({"block": r["block"]} | {c: r[c] for c in INFO}, part_types)
                elif r["block"] >= 0:
                    classes = unpack(r["classes"], np.int32).reshape(-1, LARGE)
                    sums = unpack(r["sums"], np.float64) + classes @ log_factors
                    yield _row({"block": r["block"], "docs": r["docs"], "sums": pack(sums)}, part_types)
                else:
                    history, lower = unpack(r["histories"], np.int64), unpack(r["lower"], np.float64).copy()
                    small = unpack(r["small"], np.int64).reshape(-1, LARGE).astype(float)
                    at = np.flatnonzero(unpack(r["spread"], np.int32))
                    if len(at):
                        found = np.searchsorted(wide["h"], history[at])
                        small[at], lower[at] = wide["small"][found], wide["lower"][found]
                    weight = np.log10(backoff(unpack(r["ch"], np.int64), small, lower, factors))
                    block, doc = unpack(r["u_block"], np.int64), unpack(r["u_doc"], np.int32)
                    terms = weight[unpack(r["u_at"], np.int32)]
                    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
                    for low, high in zip(edges, np.append(edges[1:], len(block)), strict=False):
                        sums = np.bincount(doc[low:high], weights=terms[low:high])
                        there = np.unique(doc[low:high])
                        packed = {"docs": pack(there), "sums": pack(sums[there])}
                        yield _row({"block": int(block[low])} | packed, part_types)

    def add(table: pa.Table) -> pa.Table:
        every = table.to_pylist()
        info = next(r for r in every if r["ids"] is not None)
        score = np.array(info["own"], float)
        for r in sorted((r for r in every if r["ids"] is None), key=lambda r: r["sums"]):
            score[unpack(r["docs"], np.int32)] += unpack(r["sums"], np.float64)
        n = len(score)
        return pa.table(
            {
                "doc_id": pa.array(info["ids"], pa.int64()),
                "held_out": pa.array([not t for t in info["train"]], pa.bool_()),
                "n_tokens": pa.array(info["n"], pa.int64()),
                "n_known": pa.array(info["known"], pa.int64()),
                "train_tokens": pa.array([parts["tokens"]] * n, pa.int64()),
                "base_score": pa.array(info["base"], pa.float64()),
                "score": pa.array(score),
            }
        )

    weighed = rows.mapInArrow(weigh, "block bigint, docs binary, sums binary, " + INFO_SCHEMA)
    return weighed.groupBy("block").applyInArrow(
        add,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double",
    )


def not_held_out(id_col: str = "doc_id") -> Column:
    """Training rows: those whose id's text has a checksum of which the remainder by 5 isn't 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 1


def score_texts(docs: DataFrame, training: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``training`` tells, from the id, which rows the model learns from.
    """
    taught = not_held_out(id_col) if training is None else training
    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(taught, F.lit(False)).alias("train"),
    )
    size, trained = source.agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.sum(F.col("train").cast("int"))
    ).first()
    buckets = max(1, -(-(size or 0) // BUCKET_BYTES))
    tokens = stored(token_blocks(source, buckets))
    words = stored(count_words(tokens, buckets))
    sums = words.where("block = -1").agg(*(F.sum(F.get("sums", F.lit(i))) for i in range(LARGE + 3))).first()
    parts = vars(_Unigrams([int(s or 0) for s in sums], int(trained or 0), buckets))
    scored = stored(score_pairs(word_pairs(tokens, words.where("block >= 0").drop("sums"), parts), parts))
    often = scored.where("block = -1").agg(*(F.sum(F.get("often", F.lit(i))) for i in range(LARGE + 1))).first()
    factors = good_turing([int(o or 0) for o in often])
    return _finish(scored, parts, factors, _spread_terms(scored))
