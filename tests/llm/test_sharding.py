import re
import zlib

from pyspark.sql import functions as F

from reviewmill.llm import sharding


def jump(key, shards):
    """The published loop on 64-bit numbers."""
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_algorithm(spark):
    ids = [*range(-40, 400), 2**63 - 1, -(2**63), 10**15]
    keys = spark.createDataFrame([(i,) for i in ids], "k bigint")
    for shards in (1, 2, 16, 17, 48, 49, 300):
        got = [r[0] for r in keys.select(sharding.jump_shard(F.col("k"), shards)).collect()]
        assert got == [jump(i, shards) for i in ids]


def test_contract(documents):
    rows = [(i, "é" * (i % 7)) for i in range(4000)] + [(None, "a"), (-3, None), (5, "five"), (5, "five")]
    got = sharding.assign(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows[:4000])
    for r in got:
        if r["doc_id"] is not None and 5 < r["doc_id"]:
            data = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    null = next(r for r in got if r["doc_id"] == -3)
    assert (null["size"], null["text_crc32"]) == (1, 0)
    for shard in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    moved = sum(r["grown_shard"] == 16 for r in got)
    assert 0.6 / 17 < moved / len(got) < 1.4 / 17


def test_native_empty_and_files(spark, documents, tmp_path):
    assert sharding.assign(documents([])).collect() == []
    plan = sharding.assign(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    sharding.write_shards(documents([(i, "t") for i in range(100)]), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    assert all(r["shard"] == jump(r["doc_id"], 4) for r in back.select("doc_id", "shard").collect())
