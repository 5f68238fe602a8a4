"""Personal data, and the terms that give it away.

Patterns find the protected entities: mail and network addresses, card and phone numbers. Then the
corpus says which terms reveal one: with line as context, the information a term carries about an
entity is log(p(term, entity) / (p(term) p(entity))), at most the entity's own -log p(entity). The
share of it that a term reveals is its disclosure, 1 if the term occurs with this entity alone. Terms
are generalised from ``GENERALISE`` on and removed from ``REMOVE`` on, wherever they stand in a line
with the entity they reveal.

An entity is protected at two levels, its value and what values share: the domain, the network, the
issuer, or the number without its last four digits.

A term counts if it stands with the entity more often than chance explains: the probability of that
many common lines, bounded by Chernoff's inequality, times the number of all pairs of a term and an
entity, is at most ``CHANCE``. Copies of a line are one line and so no evidence. Terms, entities, pairs
and the total are all counted in different lines.

Defined cases: a null or empty text has no spans; a very long text is searched whole, in linear time, and
its numbers may have any number of digits; a null id keeps its row; repeated rows get the same spans; terms
of equal disclosure (ties) are all marked; other columns are not read, and ``sanitised`` passes them on,
whatever their names; empty tables give empty results. Offsets are code points.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.words import CACHED_WORDS, blocks
from reviewmill.scale import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Pairs that chance may add, in expectation.
CHANCE = 0.05
GENERALISE = 0.85
REMOVE = 0.95
# Places of a term's hash among the terms whose lines are counted exactly.
PLACES = 1 << 24
# One line in so many, by its hash, bounds from below in how many lines a term stands.
SAMPLE = 32

# What the patterns' parts accept.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses, found from their at signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots between, out of chains of any length."""
    for chain in NUMBERS.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, start = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield start, start + length
            start += length + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in match[0]) <= 15:
            yield match.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end), by kind and start."""
    finders = (emails, addresses, cards, phones)
    return [(kind, *span) for kind, find in enumerate(finders) for span in find(text)]


def term_of(word: str) -> str:
    """A word as a term: without punctuation at its ends, A-Z in lower case; empty if nothing is left."""
    return word.strip(EDGES).encode().lower().decode()


def _shared(kind: int, value: str) -> str:
    """What an entity shares with others: domain, network, issuer, or number without its last four digits."""
    if kind < 2:
        return value.rpartition("@")[2] if kind == 0 else value.rpartition(".")[0]
    return value[:6] if kind == 2 else value[:-4]


def _contexts(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """The terms in the lines of entities: entity, line and term as hashes, and where the term stands."""
    out = []
    taken = sorted((s, e) for _, s, e in spans)
    lines: dict[tuple[int, int], set[int]] = {}
    for kind, start, end in spans:
        bounds = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        value = re.sub(r"[^0-9]", "", text[start:end]) if kind > 1 else text[start:end].lower()
        lines.setdefault(bounds, set()).update((_number(f"{kind}:{value}"), _number(f"{kind}/{_shared(kind, value)}")))
    for (start, end), entities in lines.items():
        end = len(text) if end < 0 else end
        line = _number(text[start:end])
        for word in WORD.finditer(text, start, end):
            term = term_of(word[0])
            if not term or any(s < word.end() and word.start() < e for s, e in _near(taken, word.start(), word.end())):
                continue
            at = word.start() + len(word[0]) - len(word[0].lstrip(EDGES))
            length = len(word[0].strip(EDGES))
            for entity in entities:
                out.append({"entity": entity, "line": line, "term": _number(term), "start": at, "end": at + length})
    return out


def _near(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    low = bisect.bisect_left(taken, (start, 0))
    high = bisect.bisect_left(taken, (end, 0))
    return taken[max(0, low - len(KINDS)) : high]


def _number(text: str | bytes) -> int:
    """A signed 64-bit hash, of text as UTF-8."""
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def entities(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, text): key of the text, base counts, spans and the terms around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, values in blocks(batch):
                texts = [(v or b"").decode() for v in values]
                spans = [base_spans(t) for t in texts]
                joined = [",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in own) for own in spans]
                columns = {
                    "doc_id": batch.column("doc_id").slice(start, end - start),
                    "key": pa.array([_number(t) for t in texts], pa.int64()),
                }
                for kind, name in enumerate(KINDS):
                    columns[f"n_{name}"] = pa.array([sum(k == kind for k, _, _ in own) for own in spans], pa.int64())
                columns["base"] = pa.array(joined, pa.string())
                columns["base_sha256"] = pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string())
                around = [_contexts(t, own) if own else [] for t, own in zip(texts, spans, strict=True)]
                whole = ("entity", "line", "term", "start", "end")
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in whole]))
                columns["around"] = pa.array(around, kind)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    counts = ", ".join(f"n_{name} bigint" for name in KINDS)
    around = "array<struct<entity: bigint, line: bigint, term: bigint, start: bigint, end: bigint>>"
    return docs.mapInArrow(
        run, f"doc_id bigint, key bigint, {counts}, base string, base_sha256 string, around {around}"
    )


class _Terms(dict):
    """Remembers the term hash of each word, for a bounded number of words; 0 for words without one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        term = term_of(word.decode())
        value = self[word] = _number(term) if term else 0
        return value


def _line_terms(values: list[bytes | None], hashes: _Terms) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different lines of a block; the different terms of each, and the place of their line."""
    lines = list({line for v in values for line in (v or b"").split(b"\n")})
    found = [{hashes[w] for w in line.split()} for line in lines]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    terms = np.fromiter((t for own in found for t in own), np.int64, int(lengths.sum()))
    return lines, terms, np.repeat(np.arange(len(lines)), lengths)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, least): every term, and in how many of the different lines sampled by hash it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Terms()
        for batch in batches:
            for _, _, values in blocks(batch):
                lines, terms, at = _line_terms(values, hashes)
                numbers = np.fromiter(map(_number, lines), np.int64, len(lines))
                every, sampled = np.unique(terms), numbers[at] % SAMPLE == 0
                of = [pa.nulls(len(every), pa.int64()), pa.array(numbers[at[sampled]])]
                columns = [pa.array(np.concatenate([every, terms[sampled]])), pa.concat_arrays(of)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "line"])

    rows = docs.select("text").mapInArrow(run, "term bigint, line bigint").distinct()
    return rows.groupBy("term").agg(F.count("line").alias("least"))


def term_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_term): in how many different lines each wanted term stands."""
    places = wanted.select(F.pmod("term", F.lit(PLACES)).cast("int").alias("at")).distinct().toPandas()["at"]
    among = np.zeros(PLACES, bool)
    among[places.to_numpy(np.int64)] = True
    among = docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Terms()
        for batch in batches:
            for _, _, values in blocks(batch):
                lines, terms, at = _line_terms(values, hashes)
                kept = among.value[terms % PLACES]
                terms, at = terms[kept], at[kept]
                numbers = {i: _number(lines[i]) for i in set(at.tolist())}
                of = np.fromiter((numbers[i] for i in at.tolist()), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(of)], ["term", "line"])

    rows = docs.select("text").mapInArrow(run, "term bigint, line bigint").distinct()
    return rows.groupBy("term").agg(F.count("*").alias("n_term"))


def _disclosure(n_term: Column, lines: int) -> Column:
    own = -F.log(F.col("n_entity") / F.lit(float(lines)))
    both = F.log(F.col("n_both") * F.lit(float(lines)) / (F.greatest(n_term, F.col("n_both")) * F.col("n_entity")))
    return F.when(own > 0, both / own).otherwise(F.lit(0.0))


def _chance(n_term: Column, lines: int) -> Column:
    """Log of a bound on the probability of n_both lines or more among the n_term of a term."""
    n = F.greatest(n_term, F.col("n_both")).cast("double")
    share, odds = F.col("n_both") / n, F.col("n_entity") / F.lit(float(lines))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - odds))).otherwise(F.lit(0.0))
    return F.when(share > odds, -n * (share * F.log(share / odds) + rest)).otherwise(F.lit(0.0))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity beyond ``GENERALISE``.

    A term stands in at least as many lines as among the sampled ones; only the terms that this leaves
    open are counted line by line over all texts.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line")).distinct().count() or 1
    counts = cut_lineage(term_counts(docs))
    seen = found.select(F.explode("around").alias("a")).select("a.entity", "a.line", "a.term").distinct()
    entity = cut_lineage(seen.groupBy("entity").agg(F.countDistinct("line").alias("n_entity")))
    tests = max(counts.count(), 1) * max(entity.count(), 1)
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("n_both")).join(entity, "entity")

    def revealing(n_term: Column) -> Column:
        return (_disclosure(n_term, lines) >= GENERALISE) & (_chance(n_term, lines) <= math.log(CHANCE / tests))

    pairs = pairs.where(revealing(F.col("n_both")))
    possible = pairs.join(counts, "term").where(revealing(F.greatest("least", "n_both")))
    possible = cut_lineage(possible.drop("least"))
    scored = possible.join(term_lines(docs, possible), "term").where(revealing(F.col("n_term")))
    return scored.select("entity", "term", _disclosure(F.col("n_term"), lines).alias("disclosure"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, spans and terms of every row.

    ``spans`` lists kind:start:end of all findings; ``terms`` the revealing terms' (start, end, share).
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = cut_lineage(entities(source))
    strong = disclosures(source, found)
    places = found.select("doc_id", "key", F.explode("around").alias("a"))
    places = places.join(
        strong, (places["a.entity"] == strong["entity"]) & (places["a.term"] == strong["term"])
    ).groupBy("doc_id", "key", F.col("a.start").alias("start"), F.col("a.end").alias("end"))
    places = places.agg(F.max("disclosure").alias("share"))
    terms = places.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms")
    )
    joined = found.drop("around").join(
        terms, found["doc_id"].eqNullSafe(terms["_id"]) & (found["key"] == terms["_key"]), "left"
    )
    added = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    base = F.filter(F.split("base", ","), lambda s: s != "")
    spans = F.array_join(F.concat(base, F.coalesce(added, F.array().cast("array<string>"))), ",")
    counts = [f"n_{name}" for name in KINDS]
    return joined.select("doc_id", "key", *counts, "base_sha256", spans.alias("spans"), "terms")


def _kind_of(term: Column) -> Column:
    """What a term is generalised to."""
    return (
        F.when(term.rlike("[0-9]"), "<NUMBER>").when(term.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")
    )


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with entities masked and revealing terms generalised or removed."""
    marks = found.where("spans <> ''").dropDuplicates(["doc_id", "spans"])
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"), F.col("terms").alias("_terms"))
    joined = docs.join(marks, docs[id_col].eqNullSafe(marks["_id"]), "left")
    spans, text = marks["_spans"], docs[text_col].cast("string")
    items = F.transform(
        F.filter(F.split(spans, ","), lambda s: ~s.startswith("term:")),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("bigint").alias("start"),
            F.split(s, ":")[2].cast("bigint").alias("end"),
            F.concat(F.lit("<"), F.upper(F.split(s, ":")[0]), F.lit(">")).alias("by"),
        ),
    )
    masked = F.transform(
        marks["_terms"],
        lambda t: F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            F.when(t["share"] >= REMOVE, F.lit(""))
            .otherwise(_kind_of(F.substring(text, (t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int"))))
            .alias("by"),
        ),
    )
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,by:string>>")
    every = F.array_sort(F.concat(items, F.coalesce(masked, nothing)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        every,
        start,
        lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.concat(
                    s["out"],
                    F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")),
                    x["by"],
                ).alias("out"),
            )
        ),
    )
    rest = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    clean = F.when(spans.isNull(), text).otherwise(rest)
    return joined.select(*(clean.alias(c) if c == text_col else docs[c] for c in docs.columns))
