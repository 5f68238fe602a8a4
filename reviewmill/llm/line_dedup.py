"""Repeated lines, equal or one word apart, of which the earliest stays.

A line is its words, A-Z in lower case. A line is dropped if an earlier one, by document id and place,
has the same words, or, from ``LEAST_WORDS`` words on, lies within one edit: a word put in, left out or
exchanged. Lines without words are always kept.

*Deletion neighbourhood.* A line's variants are the line without each of its words, as hashes. Lines of
one length that share a variant at the same place differ in that word alone; a line that equals another
one's variant lacks one word of it. So each variant needs only its earliest line, a minimum combined
before the shuffle, however many lines meet there. The words of both lines then confirm the edit.

Only lines that can have a neighbour emit variants: one edit leaves the first or the last half of the
shorter line whole, so a line whose halves occur in no other line has none.

Defined cases: a null or empty text has no lines and is kept as it is; rows without an id are neither
dropped from nor compared; rows that repeat an id are one document; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.joins import only_ids
from reviewmill.llm.words import WordHashes, blocks, mix, offsets, returning
from reviewmill.scale import cut_lineage

# Shorter lines are too short for an edit of a word to leave them the same.
LEAST_WORDS = 8
BASE = 0x9E3779B97F4A7C15 | 1
# What ``bytes.lower`` and ``bytes.split`` make of a byte, but for line breaks.
FOLDED = bytes(0x20 if c in b"\t\v\f\r" else c for c in bytes(range(256)).lower())


class _Powers:
    """Powers of the base of the sequence hash, and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n < len(self.up):
            return
        size = 2 * n + 64
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            setattr(self, name, np.multiply.accumulate(factors))


class _Sequences:
    """Prefix hashes of many word sequences laid end to end."""

    def __init__(self, lists: list[list[bytes]], hashes: WordHashes, powers: _Powers) -> None:
        self.n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = offsets(self.n)[:-1]
        powers.reach(int(self.n.max(initial=0)) + 1)
        self.powers = powers
        flat = hashes.of([w for words in lists for w in words])
        self.place = np.arange(len(flat)) - np.repeat(self.starts, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * powers.up[self.place], dtype=np.uint64)])

    def first(self, count: np.ndarray) -> np.ndarray:
        """Hash of the first ``count`` words of each sequence."""
        return self.sums[self.starts + count] - self.sums[self.starts]

    def last(self, count: np.ndarray) -> np.ndarray:
        skipped = self.n - count
        return (self.first(self.n) - self.first(skipped)) * self.powers.down[skipped]

    def without_each(self) -> np.ndarray:
        """Hash of each sequence without the word at each position, in order."""
        at = np.arange(len(self.place))
        start = np.repeat(self.starts, self.n)
        before = self.sums[at] - self.sums[start]
        after = self.sums[np.repeat(self.starts + self.n, self.n)] - self.sums[at + 1]
        return before + after * self.powers.down[1]


def _tagged(values: np.ndarray, *tags: np.ndarray | int) -> np.ndarray:
    for tag in tags:
        values = mix(values + np.asarray(tag).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return values.view(np.int64)


def _lines(value: bytes | None) -> list[list[bytes]]:
    return [line.split() for line in value.lower().split(b"\n")] if value else []


class _Lines:
    """The lines with words of many texts, laid end to end, words one blank apart and A-Z in lower case.

    ``text`` and ``number`` tell a line's text and its place there; ``first`` is its first word, ``n`` its words.
    """

    def __init__(self, values: list[bytes | None]) -> None:
        joined = b"\n".join(v or b"" for v in values).translate(FOLDED)
        raw = np.frombuffer(joined, np.uint8)
        blank = (raw == 0x20) | (raw == 0x0A)
        edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        begin, end = edges[::2], edges[1::2]
        breaks = np.flatnonzero(raw == 0x0A)
        line = np.searchsorted(breaks, begin)
        opens = np.diff(line, prepend=-1) > 0
        self.first = np.flatnonzero(opens)
        self.n = np.diff(self.first, append=len(begin))
        line = line[self.first]
        starts = offsets(np.fromiter((len(v or b"") + 1 for v in values), np.int64, len(values)))[:-1]
        first_line = np.searchsorted(breaks, starts)
        self.text = np.searchsorted(first_line, line, side="right") - 1
        self.number = line - first_line[self.text]
        kept = ~blank
        kept[begin[~opens] - 1] = True
        self.spelled = raw[kept].tobytes()
        # Where each word ends and begins in the spelled lines.
        self.ends = np.cumsum(end - begin + ~opens)
        self.begins = self.ends - (end - begin)

    def first_words(self, count: np.ndarray, of: np.ndarray) -> list[bytes]:
        """The first ``count`` words of the lines ``of``; at least one."""
        return self._cut(self.first[of], self.first[of] + count)

    def last_words(self, count: np.ndarray, of: np.ndarray) -> list[bytes]:
        end = self.first[of] + self.n[of]
        return self._cut(end - count, end)

    def _cut(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        spelled, bounds = self.spelled, (self.begins[low].tolist(), self.ends[high - 1].tolist())
        return [spelled[a:b] for a, b in zip(*bounds, strict=True)]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, digest, n, halves) of every line with words; line numbers start at 0.

    ``halves`` are the hashes of which a line within one edit must share one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(False)
            for start, _, values in blocks(batch):
                lines = _Lines(values)
                every = np.arange(len(lines.n))
                # A line of an odd number of words has one middle, so its two halves of either count are the same.
                wanted = np.where(lines.n >= LEAST_WORDS, np.where(lines.n % 2, 2, 4), 0)
                ends = offsets(wanted)
                keys = np.empty(ends[-1], np.int64)
                for turn, of in enumerate((np.flatnonzero(wanted), np.flatnonzero(wanted == 4))):
                    half = (lines.n[of] - turn) // 2
                    for side, parts in enumerate((lines.first_words(half, of), lines.last_words(half, of))):
                        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
                        keys[ends[of] + 2 * turn + side] = _tagged(hashes, half, side)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[start + lines.text], pa.int64()),
                        pa.array(lines.number.astype(np.int32)),
                        pa.array(map(xxhash.xxh3_128_digest, lines.first_words(lines.n, every)), pa.binary()),
                        pa.array(lines.n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys)),
                    ],
                    ["doc_id", "line_no", "digest", "n", "halves"],
                )

    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    return known.mapInArrow(returning(run), "doc_id bigint, line_no int, digest binary, n int, halves array<bigint>")


def variants(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, words, own, same, less) of the lines listed in ``lines`` of docs(doc_id, text, lines).

    ``same`` are a line's variants by place, ``less`` its variants as sequences, ``own`` itself as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, powers = WordHashes(), _Powers()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(False)
            wanted = batch.column("lines").to_pylist()
            for start, _, values in blocks(batch):
                doc, number, lists = [], [], []
                for i, value in enumerate(values):
                    cut = _lines(value)
                    for j in wanted[start + i]:
                        doc.append(start + i)
                        number.append(j)
                        lists.append(cut[j])
                lines = _Sequences(lists, hashes, powers)
                shorter = lines.without_each()
                n = np.repeat(lines.n, lines.n)
                ends = pa.array(offsets(lines.n).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[doc] if doc else np.zeros(0, np.int64), pa.int64()),
                        pa.array(number, pa.int32()),
                        pa.array([b" ".join(w).decode() for w in lists], pa.string()),
                        pa.array(_tagged(lines.first(lines.n), lines.n, 3)),
                        pa.ListArray.from_arrays(ends, pa.array(_tagged(shorter, n, 2, lines.place))),
                        pa.ListArray.from_arrays(ends, pa.array(_tagged(shorter, n - 1, 3))),
                    ],
                    ["doc_id", "line_no", "words", "own", "same", "less"],
                )

    schema = "doc_id bigint, line_no int, words string, own bigint, same array<bigint>, less array<bigint>"
    return docs.mapInArrow(returning(run), schema)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one word put in, left out or exchanged apart."""
    short = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, 1, short), F.slice(b, 1, short), lambda x, y: x == y), False).cast("int")
    rest = F.lit(2**31 - 1)

    def after(words: Column, skip: Column) -> Column:
        return F.slice(words, at + skip, rest)

    longer_a, longer_b = (F.size(a) > F.size(b)).cast("int"), (F.size(b) > F.size(a)).cast("int")
    one = F.abs(F.size(a) - F.size(b)) <= 1
    same = after(a, F.lit(1) - longer_b) == after(b, F.lit(1) - longer_a)
    return one & F.when(at == 0, F.lit(True)).otherwise(same)


def neighbours(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(digest, doc_id, line_no): distinct lines within one edit of an earlier one, and which it is."""
    halves = distinct.where(F.size("halves") > 0).select("digest", "first", F.explode("halves").alias("half"))
    met = halves.withColumn("lines", F.count("*").over(Window.partitionBy("half"))).where("lines > 1")
    met = cut_lineage(met.select("digest", "first").distinct())
    listed = met.groupBy("first.doc_id").agg(F.sort_array(F.collect_list("first.line_no")).alias("lines"))
    listed = cut_lineage(listed)
    texts = only_ids(docs, listed.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]).join(listed, "doc_id")
    held = cut_lineage(variants(texts))
    order = F.struct("doc_id", "line_no").alias("line")
    roles = F.concat(
        F.transform("same", lambda k: F.struct(k.alias("key"), F.lit(0).alias("role"))),
        F.array(F.struct(F.col("own").alias("key"), F.lit(1).alias("role"))),
        F.transform("less", lambda k: F.struct(k.alias("key"), F.lit(2).alias("role"))),
    )
    rows = held.select(order, F.explode(roles).alias("r")).select("line", "r.*")
    earliest = rows.groupBy("key").agg(
        *(F.min(F.when(F.col("role") == role, F.col("line"))).alias(f"line{role}") for role in range(3)),
        F.count("*").alias("rows"),
    )
    other = F.when(F.col("role") == 0, F.col("line0")).when(F.col("role") == 1, F.col("line2")).otherwise(F.col("line1"))
    found = rows.join(earliest.where("rows > 1"), "key").select("line", other.alias("other")).where("other < line")
    found = found.distinct()
    words = held.select(order, F.split("words", " ").alias("words"))
    pairs = found.join(words, "line").join(words.select(F.col("line").alias("other"), F.col("words").alias("theirs")), "other")
    near = pairs.where(within_one_edit(F.col("words"), F.col("theirs"))).groupBy("line").agg(F.min("other").alias("other"))
    return met.join(near, met["first"] == near["line"]).select("digest", "other.*")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True) -> DataFrame:
    """(doc_id, line_no, of_doc, of_line) of every dropped line, and the earlier line that it repeats."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = cut_lineage(line_table(source))
    place = F.struct("doc_id", "line_no")
    distinct = lines.groupBy("digest").agg(F.min(place).alias("first"), F.first("halves").alias("halves"))
    firsts = distinct.select("digest", "first")
    if near:
        earlier = neighbours(source, distinct).select("digest", F.struct("doc_id", "line_no").alias("like"))
        firsts = firsts.join(cut_lineage(earlier), "digest", "left")
    else:
        firsts = firsts.withColumn("like", F.lit(None).cast("struct<doc_id: bigint, line_no: int>"))
    joined = lines.select("digest", "doc_id", "line_no").join(firsts, "digest")
    again = joined.where((F.struct("doc_id", "line_no") != F.col("first")) | F.col("like").isNotNull())
    of = F.when(F.struct("doc_id", "line_no") != F.col("first"), F.col("first")).otherwise(F.col("like"))
    return again.select("doc_id", "line_no", of["doc_id"].alias("of_doc"), of["line_no"].alias("of_line")).distinct()


def by_document(dropped: DataFrame) -> DataFrame:
    """(doc_id, dropped): the numbers of each document's dropped lines, ascending."""
    return dropped.groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("dropped"))


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their dropped lines; those of which no word is left go."""
    gone = dropped.select(F.col("doc_id").alias("_line_doc"), F.col("dropped").alias("_line_numbers"))
    joined = docs.join(gone, docs[id_col] == gone["_line_doc"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, keep = [], []
            values = batch.column(at).to_pylist()
            for value, numbers in zip(values, batch.column("_line_numbers").to_pylist(), strict=True):
                if numbers and value is not None:
                    out = set(numbers)
                    value = "\n".join(line for i, line in enumerate(value.split("\n")) if i not in out)
                    keep.append(bool(value.encode().split()))
                else:
                    keep.append(True)
                texts.append(value)
            kind = batch.schema.field(at).type
            whole = batch.set_column(at, batch.schema.field(at), pa.array(texts, kind))
            yield whole.drop_columns(["_line_numbers"]).filter(pa.array(keep))

    return joined.select(*(docs[c] for c in docs.columns), "_line_numbers").mapInArrow(returning(run), docs.schema)
