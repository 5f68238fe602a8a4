"""The registered queries of the operators, over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.llm import (
    byte_bpe,
    clustering,
    hard_negatives,
    katz,
    knn,
    line_dedup,
    mixing,
    near_dup,
    quality_rules,
    resampling,
    sanitise,
    segmentation,
    sharding,
)

# The model file; executors get its pieces from the driver.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the equivalent SQL if there is one."""

    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query()
def op1_minhash_near_dedup(spark, sf_dir):
    return near_dup.classes(_documents(spark, sf_dir))


_BLANKS = r"\x20\x09-\x0D"
_LEVEL = "g.level, g.lang, g.source, g.signal"


def _outside_sql(name: str, condition: str) -> str:
    """Tables up to <name>_outside: of the rates under the condition, those outside the fences these make."""
    fence = "CASE WHEN o.docs >= 200 THEN o.{0} WHEN l.docs >= 200 THEN l.{0} ELSE a.{0} END"
    return f"""{name} AS (SELECT * FROM rates WHERE {condition}),
    {name}_buckets AS (
        SELECT lang, source, signal, v - v % u AS low, v - v % u + u - 1 AS high
        FROM (SELECT *, CAST(1 AS BIGINT) << greatest(0, length(bin(v)) - 7) AS u FROM {name})),
    {name}_levels AS (
        SELECT 0 AS level, lang, source, signal, low, high FROM {name}_buckets
        UNION ALL SELECT 1, lang, NULL, signal, low, high FROM {name}_buckets
        UNION ALL SELECT 2, NULL, NULL, signal, low, high FROM {name}_buckets),
    {name}_sketches AS (SELECT level, lang, source, signal, low, high, count(*) AS n FROM {name}_levels GROUP BY ALL),
    {name}_ranked AS (
        SELECT g.*, sum(n) OVER (PARTITION BY {_LEVEL} ORDER BY low) AS upto, sum(n) OVER (PARTITION BY {_LEVEL}) AS docs,
               lag(high) OVER (PARTITION BY {_LEVEL} ORDER BY low) AS before FROM {name}_sketches g),
    {name}_cut AS (
        SELECT g.*, min(low) FILTER (low > 8 * greatest(before, 200) AND (upto - n) * 4 >= docs * 3) OVER (PARTITION BY {_LEVEL}) AS cut
        FROM {name}_ranked g),
    {name}_tails AS (SELECT g.*, sum(n) FILTER (cut IS NULL OR low < cut) OVER (PARTITION BY {_LEVEL}) AS tail FROM {name}_cut g),
    {name}_quantiles AS (
        SELECT {_LEVEL}, max(docs) AS docs, min(low) FILTER (upto * 100 >= docs * 25) AS q25, min(high) FILTER (upto * 100 >= docs * 75) AS q75,
               min(high) FILTER (upto * 100 >= tail * 90) AS q90, min(high) FILTER (upto * 100 >= tail * 99) AS q99
        FROM {name}_tails g GROUP BY {_LEVEL}),
    {name}_fences AS (
        SELECT *, CASE signal WHEN 'word_length' THEN q25 - greatest(3 * (q75 - q25), 1500) ELSE 0 END AS least,
               CASE signal WHEN 'word_length' THEN q75 + greatest(3 * (q75 - q25), 1500)
                    ELSE greatest(q75 + 3 * (q75 - q25), q99 + greatest(2 * (q99 - q90), 200)) END AS most
        FROM {name}_quantiles),
    {name}_outside AS (
        SELECT r.doc_id, r.signal FROM {name} r
        JOIN {name}_fences o ON o.level = 0 AND o.lang IS NOT DISTINCT FROM r.lang AND o.source IS NOT DISTINCT FROM r.source AND o.signal = r.signal
        JOIN {name}_fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM r.lang AND l.signal = r.signal
        JOIN {name}_fences a ON a.level = 2 AND a.signal = r.signal
        WHERE r.v > {fence.format("most")} OR r.v < {fence.format("least")})"""


@query(
    rf"""
    WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    cut AS (
        SELECT *, regexp_extract_all(text, '[^{_BLANKS}]+') AS words,
               list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{_BLANKS}]')) AS lines FROM docs),
    windows AS (
        SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS gram
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM cut)),
    again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    counted AS (
        SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
               length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM cut LEFT JOIN covered USING (doc_id)),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
    rates AS (
        SELECT doc_id, lang, source, base_failed, 'word_length' AS signal, 1000 * word_chars // greatest(n_words, 1) AS v FROM judged
        UNION ALL SELECT doc_id, lang, source, base_failed, 'symbols', 10000 * n_symbols // greatest(n_words, 1) FROM judged
        UNION ALL SELECT doc_id, lang, source, base_failed, 'dup_lines', 10000 * n_dup_lines // greatest(n_lines, 1) FROM judged
        UNION ALL SELECT doc_id, lang, source, base_failed, 'repeats', 10000 * n_repeat_words // greatest(n_words, 1) FROM judged),
    {_outside_sql("words", "signal = 'word_length' AND NOT base_failed")},
    {_outside_sql("tails", "signal <> 'word_length' AND NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM words_outside)")},
    reasons AS (
        SELECT doc_id, min_by(signal, CASE signal WHEN 'word_length' THEN 1 WHEN 'symbols' THEN 2 WHEN 'dup_lines' THEN 3 ELSE 4 END) AS reason
        FROM (FROM words_outside UNION ALL FROM tails_outside) GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
           NOT base_failed AND reason IS NULL AS kept, CASE WHEN base_failed THEN 'base' ELSE reason END AS reason
    FROM judged LEFT JOIN reasons USING (doc_id)
    """
)
def op2_adaptive_quality_rules(spark, sf_dir):
    return quality_rules.judge(_documents(spark, sf_dir))


@query()
def op3_katz_backoff(spark, sf_dir):
    return katz.score_texts(_documents(spark, sf_dir))


@query()
def op4_importance_resampling(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    return resampling.resample(_documents(spark, sf_dir), good)


@query()
def op5_disclosure_sanitising(spark, sf_dir):
    found = sanitise.find(_documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query(
    """
    WITH points AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
        FROM points q JOIN points x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """
)
def op6_voronoi_knn(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.search(vectors, F.col("id") % 20 == 0)


@query()
def op7_gumbel_segmentations(spark, sf_dir):
    return segmentation.encode(_documents(spark, sf_dir), MODEL, k=2)


@query(
    rf"""
    WITH cut AS (
        SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS lines
        FROM documents),
    numbered AS (SELECT doc_id, i AS line_no, lines[i + 1] AS line FROM (SELECT *, unnest(range(len(lines))) AS i FROM cut)),
    worded AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^{_BLANKS}]+') AS words FROM numbered),
    placed AS (
        SELECT doc_id, line_no, words, array_to_string(words, ' ') AS key, doc_id * 1000000 + line_no AS place FROM worded WHERE len(words) > 0),
    firsts AS (SELECT key, any_value(words) AS words, min(place) AS place FROM placed GROUP BY key),
    variants AS (
        SELECT key, place, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') AS less, len(words) AS n
        FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM firsts WHERE len(words) >= 8)),
    near AS (
        SELECT place FROM (SELECT place, min(place) OVER (PARTITION BY n, i, less) AS earliest FROM variants) WHERE earliest < place
        UNION
        SELECT greatest(v.place, f.place) FROM variants v JOIN firsts f ON f.key = v.less AND len(f.words) >= 8),
    gone AS (
        SELECT p.doc_id, p.line_no FROM placed p JOIN firsts f USING (key)
        WHERE p.place > f.place OR f.place IN (SELECT place FROM near)),
    listed AS (SELECT doc_id, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) AS l FROM gone GROUP BY doc_id)
    SELECT doc_id, len(lines) AS n_lines, coalesce(n, 0) AS n_dropped, coalesce(l, '') AS dropped_lines FROM cut LEFT JOIN listed USING (doc_id)
    """
)
def op8_line_dedup(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    dropped = line_dedup.by_document(line_dedup.dropped_lines(docs))
    lines = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint").alias("n_lines"))
    return lines.join(dropped, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"),
    )


@query(
    """
    WITH RECURSIVE docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id, -1) % 18446744073709551616::HUGEINT AS key
        FROM documents),
    crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
                   lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    sized AS (
        SELECT r, octet_length(encode(text)) + 1 AS size,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                       lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
        FROM docs, crc_table),
    jumps AS (
        SELECT r, n, key::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM docs, (SELECT unnest([16, 17]) AS n)
        UNION ALL
        SELECT r, n, next, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((next // 8589934592) + 1)::DOUBLE))::BIGINT
        FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next FROM jumps WHERE j < n)),
    shards AS (
        SELECT r, max(b) FILTER (n = 16)::INTEGER AS shard, max(b) FILTER (n = 17)::INTEGER AS grown_shard FROM jumps WHERE j >= n GROUP BY r),
    parts AS (
        SELECT r, ((key * 2862933555777941757::HUGEINT + 1) % 4294967296::HUGEINT) // 4194304 AS part FROM docs)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, grown_shard
    FROM docs JOIN sized USING (r) JOIN shards USING (r) JOIN parts USING (r)
    """
)
def op9_jump_sharding(spark, sf_dir):
    return sharding.assign(_documents(spark, sf_dir))


@query()
def op10_soft_mixing(spark, sf_dir):
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return mixing.mix(_documents(spark, sf_dir), good, least=1.0)


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


@query(
    f"""
    WITH points AS (
        SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_SOUND}),
    scored AS (
        SELECT q.r AS anchor, q.vec_id AS anchor_id, q.label = x.label AS same, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
        FROM points q JOIN points x ON q.r <> x.r WHERE q.vec_id % 100 = 0),
    positives AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
        WHERE place <= 5),
    pairs AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5
    """
)
def op11_inverted_multi_index(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", changed), F.col("id") % 100 == 0)


@query()
def op12_byte_level_bpe(spark, sf_dir):
    import public_tokenizers

    ranks = byte_bpe.read_ranks(public_tokenizers.path(RANKS))
    encoded = byte_bpe.encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _rounds_sql(n: int) -> str:
    """The common tables of n rounds and of the assignment after them: a0, c1, a1, ... of centroids c0."""
    far = "list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v)"
    parts = []
    for i in range(n + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT p.r, min((({far})::BIGINT, c.c)) AS best FROM points p, c{i} c GROUP BY p.r)"
        )
        if i < n:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (
        SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
            SELECT c, list(floor(s / n) ORDER BY d) AS v FROM (
                SELECT c, d, sum(x) AS s, count(*) AS n FROM (
                    SELECT best[2] AS c, unnest(p.v) AS x, unnest(range(len(p.v))) AS d FROM a{i} JOIN points p USING (r)) GROUP BY c, d)
            GROUP BY c) m USING (c))"""
            )
    return ",\n    ".join(parts)


@query(
    f"""
    WITH points AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE len(embedding) = 64 AND {_SOUND}),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM points ORDER BY sha256('2:' || vec_id), v LIMIT 40),
    {_rounds_sql(5)},
    found AS (SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance FROM a5 JOIN points USING (r))
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(list_transform(c5.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
    FROM found JOIN c5 ON c5.c = found.cluster
    """
)
def op13_threshold_clusters(spark, sf_dir):
    assigned, centroids = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return clustering.with_inertia(spark, assigned, centroids)
