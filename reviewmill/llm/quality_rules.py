"""Quality rules with thresholds that adapt to each language and source.

The signals of all documents go into mergeable quantile sketches: counts of logarithmic buckets,
whose sum is the sketch of the union. A group of too few documents is judged by the merged sketch
of its language, or of all documents. Fences beyond which a document is dropped follow in two steps.
Word lengths vary in every document: their fences are the quartiles, three quartile distances out.
Symbols, repeated lines and repeats are zero in most documents, so quartiles say nothing about them:
their fence carries on the upper tail. Where one document in ten is above q90 and one in a hundred
above q99, a tail that falls exponentially has one in ten thousand above q99 + 2 * (q99 - q90). That
tail is sketched from the documents whose word lengths are inside their fences, and ends where the
sketch breaks off: at values ``BREAK`` times those before, with no document between and at most a
quarter of the documents beyond. So junk that stands apart doesn't lift the fences it is judged by,
and what shades off from the usual of a group is usual there and stays. ``RESOLUTION`` keeps groups
without any such value from rejecting a single occurrence, ``SLACK`` those without spread from
rejecting small differences of word length.

Defined cases: a null text counts as empty and fails for its length; null languages and sources are
groups of their own; empty tables give empty results; repeated rows are judged alike. Only the id,
text, language and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.scale import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEATED_PERCENT = 50
# Fences are quartiles plus or minus three times their distance.
SPREAD = 3
LEAST_DOCS = 200
# Bits of a value that its bucket keeps: bounds are exact to one part in 64.
BITS = 7
SIGNALS = ("word_length", "symbols", "dup_lines", "repeats")
# Signals with quartiles, and fences on both sides; the others are zero in most documents.
SPREAD_OUT = SIGNALS[:1]
# Least distance of a word length's fence from its quartile, in thousandths of a character.
SLACK = 1500
# Least distance of the others' fence from q99, per ten thousand: one word of the shortest text.
RESOLUTION = 10_000 // LEAST_WORDS
# Powers of ten by which a fence is beyond q99, which is one such power beyond q90.
FURTHER = 2
# A tail ends before values this many times as large as those, and the resolution, before.
BREAK = 8


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source and what is counted in each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        text.alias("text"),
        F.array_remove(F.split(text, BLANKS), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    at = F.sequence(F.lit(0), F.size("words") - 3)
    window = F.transform(at, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(3))))
    windows = base.withColumn("windows", F.when(F.size("words") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    counted = windows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    )
    same = F.filter(
        "sorted",
        lambda x, i: (x["h"] == F.get("sorted", i + 1)["h"]) | ((i > 0) & (x["h"] == F.get("sorted", i - 1)["h"])),
    )
    places = counted.withColumn("places", F.array_sort(F.transform(same, lambda x: x["i"]))).drop("sorted")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        "places",
        start,
        lambda s, p: F.struct((p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n")),
        lambda s: s["n"],
    )
    repeated = F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")
    return places.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeated
    )


def _rates() -> Column:
    """The signals as whole numbers that documents of any length share."""
    per_word = F.greatest("n_words", F.lit(1))
    values = {
        "word_length": F.expr("1000 * word_chars") / per_word,
        "symbols": F.expr("10000 * n_symbols") / per_word,
        "dup_lines": F.expr("10000 * n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.expr("10000 * n_repeat_words") / per_word,
    }
    return F.array(*(F.struct(F.lit(k).alias("signal"), F.floor(v).cast("bigint").alias("v")) for k, v in values.items()))


def _group(level: Column, lang: Column, source: Column) -> Column:
    """Key of a group: 0 one language of one source, 1 one language, 2 all; nulls are values here."""
    return F.struct(
        level.cast("int").alias("level"),
        F.when(level < 2, lang).alias("lang"),
        F.when(level < 1, source).alias("source"),
    )


def sketch(rates: DataFrame) -> DataFrame:
    """Mergeable sketches (grp, signal, low, high, n): documents by bucket of their value."""
    shift = F.greatest(F.lit(0), F.length(F.bin("v")) - BITS)
    unit = F.pow(F.lit(2), shift).cast("bigint")
    low = (F.col("v") - F.col("v") % unit).alias("low")
    grp = _group(F.lit(0), F.col("lang"), F.col("source")).alias("grp")
    return rates.groupBy(grp, "signal", low, (low + unit - 1).alias("high")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, level: int) -> DataFrame:
    """The sketches of larger groups, as sums of those of the groups within."""
    grp = _group(F.lit(level), F.col("grp.lang"), F.col("grp.source")).alias("grp")
    return sketches.groupBy(grp, "signal", "low", "high").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """Per group: its number of documents, and the bounds that follow from its quantiles."""
    upto = Window.partitionBy("grp", "signal").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketches.withColumn("upto", F.sum("n").over(upto))
    every = Window.partitionBy("grp", "signal")
    ranked = ranked.withColumn("docs", F.sum("n").over(every))
    before = F.lag("high").over(Window.partitionBy("grp", "signal").orderBy("low"))
    apart = (F.col("low") > BREAK * F.greatest(before, F.lit(RESOLUTION))) & ((F.col("upto") - F.col("n")) * 4 >= F.col("docs") * 3)
    ranked = ranked.withColumn("apart", apart).withColumn("cut", F.min(F.when(F.col("apart"), F.col("low"))).over(every))
    ranked = ranked.withColumn("near", F.isnull("cut") | (F.col("low") < F.col("cut")))
    ranked = ranked.withColumn("tail", F.sum(F.when(F.col("near"), F.col("n"))).over(every))

    def quantile(percent: int, side: str, of: str) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col(of) * percent, F.col(side))).alias(f"q{percent}")

    known = ranked.groupBy("grp", "signal").agg(
        quantile(25, "low", "docs"),
        quantile(75, "high", "docs"),
        quantile(90, "high", "tail"),
        quantile(99, "high", "tail"),
        F.max("docs").alias("docs"),
    )
    wide = SPREAD * (F.col("q75") - F.col("q25"))
    tail = F.col("q99") + F.greatest(FURTHER * (F.col("q99") - F.col("q90")), F.lit(RESOLUTION))
    both = F.col("signal").isin(*SPREAD_OUT)
    reach = F.greatest(wide, F.lit(SLACK))
    bounds = known.withColumn("least", F.when(both, F.col("q25") - reach)).withColumn(
        "most", F.when(both, F.col("q75") + reach).otherwise(F.greatest(F.col("q75") + wide, tail))
    )
    sides = [
        F.max(F.when(F.col("signal") == signal, F.col(side))).alias(f"{signal}_{side}")
        for signal in SIGNALS
        for side in ("least", "most")
    ]
    return bounds.groupBy("grp").agg(F.struct(F.max("docs").alias("docs"), *sides).alias("fence"))


def _own_fences(sketches: DataFrame) -> DataFrame:
    """Per language and source (``grp``) the fence of the smallest group around it that has documents enough."""
    known = fences(sketches.union(merge(sketches, 1)).union(merge(sketches, 2)))
    level = F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("level")
    wanted = sketches.select("grp").distinct().select(F.col("grp").alias("own"), level)
    wanted = wanted.select("own", "level", _group(F.col("level"), F.col("own.lang"), F.col("own.source")).alias("grp"))
    enough = (F.col("fence.docs") >= LEAST_DOCS) | (F.col("level") == 2)
    found = wanted.join(known, "grp").where(enough)
    return found.groupBy(F.col("own").alias("grp")).agg(F.min_by("fence", "level").alias("fence"))


def _step(counted: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows, whose ``reason`` is the first of these signals outside its fence if there was none before."""
    left = counted.where("reason IS NULL").select("lang", "source", F.explode("rates").alias("r"))
    sketches = cut_lineage(sketch(left.select("lang", "source", "r.*").where(F.col("signal").isin(*names))))
    joined = counted.join(_own_fences(sketches), "grp", "left")
    reason = F.col("reason")
    for signal in names:
        value = F.get("rates", F.lit(SIGNALS.index(signal)))["v"]
        outside = (value > F.col(f"fence.{signal}_most")) | (value < F.col(f"fence.{signal}_least"))
        reason = F.coalesce(reason, F.when(outside, F.lit(signal)))
    return joined.withColumn("reason", reason).drop("fence")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the signals, base_failed, kept, and reason: ``base``, or the first signal outside a fence of its group."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    counted = signals(docs, id_col, text_col).withColumn("base_failed", failed)
    counted = cut_lineage(
        counted.withColumn("rates", _rates())
        .withColumn("grp", _group(F.lit(0), F.col("lang"), F.col("source")))
        .withColumn("reason", F.when(F.col("base_failed"), F.lit("base")))
    )
    judged = _step(_step(counted, SPREAD_OUT), SIGNALS[len(SPREAD_OUT) :])
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *numbers, "n_lines", "base_failed", F.isnull("reason").alias("kept"), "reason")
