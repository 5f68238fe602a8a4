"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its ``SKETCH`` smallest hashes.
Inverted lists of retained values give the overlapping pairs, the sketch of a pair's union estimates
its similarity, and the whole sets decide. Shingles are compared by 63-bit hashes.

*Which pairs meet.* Of the 64 smallest values of a union, those in the intersection are in both
sketches. A pair of similarity 0.75 shares fewer than ``SHARED`` of them with a probability below
3e-9; sets that fit whole into their sketches share what they must with certainty. So it is enough
to meet in one of a sketch's values other than its SHARED - 1 most frequent: the values of passages
that many documents hold don't list those documents together.

*Large groups.* Texts equal in their words are one class from the start. Each list then compares its
members with one of them, a star; classes that link become one. The sets in lists that still
hold several components are listed anew by their rarest shingles, a quarter of each set. Lists that
are still mixed are joined into clusters, whose members meet block by block inside tasks, where matrix
products count common shingles and only links between components come out. No link between different
texts is lost, and a group of copies costs rows per member, not per pair.

Defined cases: a text that is null or has no words has no shingles and is linked with nothing; with
fewer than five words the whole sequence is its one shingle. Rows with a null id take no part in
links and keep a null component. Rows of one id are one document; if their texts differ, the one
with the smallest digest counts. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.components import connected_components
from reviewmill.llm.joins import only_ids, without_ids
from reviewmill.llm.words import WordHashes, blocks, mix, ngram_hashes, offsets, returning
from reviewmill.scale import cut_lineage

SHINGLE = 5
PERCENT = 75
SKETCH = 64
SHARED = 24
# Sets up to this size, and all that can be similar to them, fit whole into a sketch of 64.
WHOLE = 48
STARS = 1
BLOCK = 256
COLUMNS = 8192


def shingle_sets(lists: list[list[bytes]], hashes: WordHashes, n: int = SHINGLE) -> list[np.ndarray]:
    """The distinct hashed shingles of each word list, in ascending order."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = offsets(lengths)
    flat = hashes.of([w for words in lists for w in words])
    grams = ngram_hashes(flat, n)
    out = []
    for start, length in zip(ends[:-1].tolist(), lengths.tolist(), strict=True):
        if length >= n:
            out.append(np.unique(grams[start : start + length - n + 1]))
        elif length:
            whole = ngram_hashes(flat[start : start + length], length)
            out.append(mix(whole + np.uint64(length)))
        else:
            out.append(np.zeros(0, np.uint64))
    return [s >> np.uint64(1) for s in out]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH) -> DataFrame:
    """Row by row: doc_id, n_shingles, digest of the word sequence (null without words), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start, end, values in blocks(batch):
                lists = [(v or b"").lower().split() for v in values]
                sets = shingle_sets(lists, hashes)
                digests = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in lists]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "sketch"],
                )

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(returning(run), "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>")


def retained_values(sets: DataFrame, whole: bool = False) -> DataFrame:
    """(value, id, n) for the values in which a similar set must meet one of ``sets`` (id, n, values).

    Rare values come first. A set must share ``least`` of its values, so one of the others' number
    plus one rarest is shared. The values are sketches, or with ``whole`` the sets themselves.
    """
    values = sets.select("id", "n", F.explode("values").alias("value"))
    # Counted before the shuffle, and joined back, so that a value in very many sets can be split.
    counts = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(counts, "value").groupBy("id").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values")
    )
    least = F.ceil(F.col("n") * PERCENT / 100).cast("int")
    if not whole:
        least = F.when(F.col("n") <= WHOLE, least).otherwise(SHARED)
    count = F.size("values") - least + 1
    rare = shared.where(count > 0).select("id", "n", F.explode(F.slice("values", 1, count)).alias("v"))
    return rare.select("v.value", "id", "n")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the first of its component)."""
    sketched = cut_lineage(sketches(docs, id_col, text_col))
    documents = cut_lineage(
        sketched.groupBy("doc_id").agg(
            F.min(F.struct("digest", "n_shingles")).alias("d"), F.max("digest").alias("last")
        ).select("doc_id", "d.*", "last")
    )
    one_text = documents.where("digest <> last OR (digest IS NULL AND last IS NOT NULL)").isEmpty()
    copies = documents.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    copies = cut_lineage(copies.agg(F.min("doc_id").alias("id")))
    reps = sketched.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "digest", F.col("sketch").alias("values"))
    reps = only_ids(reps, copies.select("id"), "id")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not one_text:
        reps = reps.join(copies, ["id", "digest"], "left_semi")
    lists = cut_lineage(retained_values(reps.dropDuplicates(["id"]) if not one_text else reps))
    sets = _sets(only_ids(source, lists.select("id").distinct(), "id"))
    if not one_text:
        sets = sets.join(copies, ["id", "digest"], "left_semi")
    components = _components(lists, cut_lineage(sets.dropDuplicates(["id"])))
    return (
        documents.join(copies, "digest", "left")
        .join(components, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those that ``found``, from ``classes``, doesn't keep; each id once."""
    others = found.where("NOT kept").select(F.col("doc_id").alias(id_col))
    left = without_ids(docs, others, id_col)
    again = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    again = cut_lineage(again)
    if again.isEmpty():
        return left
    return without_ids(left, again, id_col).unionByName(only_ids(left, again, id_col).dropDuplicates([id_col]))


def _sets(texts: DataFrame) -> DataFrame:
    """(id, n, digest, shingles): the whole sets of the documents given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start, end, values in blocks(batch):
                lists = [(v or b"").lower().split() for v in values]
                sets = shingle_sets(lists, hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in lists], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "n", "digest", "shingles"],
                )

    return texts.mapInArrow(returning(run), "id bigint, n bigint, digest binary, shingles array<bigint>")


def _components(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Components of the classes in the lists: stars first, then blocks for what is left."""
    spark = lists.sparkSession
    links = spark.createDataFrame([], "a bigint, b bigint")
    components = spark.createDataFrame([], "id bigint, component bigint")
    for turn in range(STARS):
        labelled = _mixed(lists, components)
        links = links.union(cut_lineage(linked(_star(labelled, turn), sets)))
        components = cut_lineage(connected_components(links))
    left = _mixed(lists, components).select("id").distinct()
    held = sets.join(left, "id", "left_semi").select("id", "n", F.col("shingles").alias("values"))
    labelled = _mixed(retained_values(held, whole=True), components)
    return connected_components(links.union(cut_lineage(block_links(labelled, sets))))


def _mixed(lists: DataFrame, components: DataFrame) -> DataFrame:
    """Members, with their components, of the lists that hold more than one component."""
    labelled = lists.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return cut_lineage(labelled.join(mixed.where("low < high").select("value"), "value", "left_semi"))


def block_links(labelled: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components among the lists given, found in blocks.

    Lists that share members form a cluster. A cluster's members are dealt into blocks of about
    ``BLOCK``, every two blocks meet in one task, and only links come out of it.
    """
    star = labelled.groupBy("value").agg(F.min("id").alias("b"))
    clusters = connected_components(labelled.join(star, "value").select(F.col("id").alias("a"), "b"))
    members = labelled.select("id", F.col("component").alias("own")).distinct().join(
        clusters.withColumnRenamed("component", "cluster"), "id"
    )
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = members.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = cut_lineage(members.select("id", "own", "cluster", "part", other))
    dealt = dealt.join(sets.select("id", "n", "shingles"), "id").select(
        "cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "own", "n", "shingles"
    )
    return dealt.groupBy("cluster", "i", "j").applyInArrow(_links_of_block, "a bigint, b bigint")


def _links_of_block(table: pa.Table) -> pa.Table:
    """Counts the common shingles of all rows of two blocks by products of 0-1 matrices."""
    n = table.column("n").to_numpy()
    ids, own, part = (table.column(c).to_numpy() for c in ("id", "own", "part"))
    rows = np.repeat(np.arange(len(n)), n)
    values = table.column("shingles").combine_chunks().flatten().to_numpy()
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(fresh) - 1
    common = np.bincount(column) > 1
    keep = common[column]
    column = (np.cumsum(common) - 1)[column[keep]]
    rows = rows[keep]
    first, second = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    counts = np.zeros((len(n), len(n)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(n), COLUMNS), np.float32)
        held[rows[low:high], column[low:high] - start] = 1
        counts[np.ix_(first, second)] += held[first] @ held[second].T
    union = n[:, None] + n[None, :] - counts
    near = (100 * counts >= PERCENT * union) & (own[:, None] != own[None, :])
    inside = np.zeros_like(near)
    inside[np.ix_(first, second)] = True
    a, b = np.nonzero(near & inside)
    return pa.table({"a": ids[a], "b": ids[b]})


def _similar_sizes():
    return F.expr(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")


def _star(labelled: DataFrame, turn: int) -> DataFrame:
    """Each member of a list with one of them; every round another one, the smallest id at first."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    middle = labelled.groupBy("value").agg(F.min_by(F.struct("id", "n", "component"), order).alias("mid"))
    pairs = labelled.join(middle, "value").where("component <> mid.component").select(
        F.least("id", "mid.id").alias("a"), F.greatest("id", "mid.id").alias("b"), F.col("n").alias("na"), F.col("mid.n").alias("nb")
    )
    return pairs.where(_similar_sizes()).select("a", "b").distinct()


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar: estimated from the sketches first, then counted."""
    small = sets.select("id", "n", F.slice("shingles", 1, SKETCH).alias("sketch"))
    near = (
        pairs.join(small.toDF("a", "na", "sa"), "a")
        .join(small.toDF("b", "nb", "sb"), "b")
        .withColumn("u", F.array_sort(F.array_union("sa", "sb")))
        .withColumn("shared", F.array_intersect("sa", "sb"))
    )
    whole = F.greatest("na", "nb") <= SKETCH
    in_sketch = F.size(F.array_intersect("shared", F.slice("u", 1, SKETCH)))
    likely = F.when(whole, 100 * F.size("shared") >= PERCENT * F.size("u")).otherwise(in_sketch >= SHARED)
    near = near.where(likely).select("a", "b")
    full = sets.select("id", "n", "shingles")
    both = near.join(full.toDF("a", "na", "sa"), "a").join(full.toDF("b", "nb", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= PERCENT * (F.col("na") + F.col("nb") - shared)).select("a", "b")
