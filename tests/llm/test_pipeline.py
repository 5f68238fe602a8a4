import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from reviewmill.llm import features, words
from reviewmill.llm.queries import MODEL, QUERIES
from reviewmill.llm.words import BLOCK_BYTES

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="the model file isn't there")


@pytest.fixture
def folder(tmp_path, documents, prose, spark):
    """Clean, junk and copied documents in two languages, with labels for some."""
    rows, labels = [], []
    for i in range(160):
        lang = "en" if i % 4 else "de"
        words = [("d" if lang == "de" else "") + w for w in prose(i, 150)]
        lines = [words[j : j + 15] for j in range(0, 150, 15)]
        if i % 8 == 5:
            lines = [[w + "$$$" for w in line] for line in lines]
        rows.append((i, "\n".join(map(" ".join, lines)), lang, "s"))
        if i % 3:
            labels.append((i, int(i % 8 != 5), 0))
    rows += [(500 + i, rows[i][1], "en", "copies") for i in (1, 2, 3)]
    near = rows[6][1].replace(" ", "  changed ", 1)
    rows += [(600, near, "en", "near"), (700, None, "en", "null"), (701, "", None, None), (None, "no id", "en", "s")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after[name] = docs
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in after.items()}
    clean = {i for i in range(160) if i % 8 != 5}
    assert clean <= ids["quality_classifier"] and not ids["quality_classifier"] & {i for i in range(160) if i % 8 == 5}
    assert clean <= ids["line_dedup"] and not ids["line_dedup"] & {501, 502, 503}
    assert clean <= ids["minhash_near_dedup"] == ids["mixing"] == ids["segmentation"]
    assert after["mixing"].where("lang = 'de'").count() > after["minhash_near_dedup"].where("lang = 'de'").count()
    assert after["line_dedup"].where("n_chars <> length(text)").count() == 0
    assert after["segmentation"].where("NOT round_trip").where(F.col("doc_id") != 700).count() == 0


def test_near_duplicates_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert not left & {501, 502, 503, 600} and {1, 2, 3, 6, 700, 701, None} <= left


def test_stages_send_texts_in_small_batches(spark, folder):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("abcdefg "), 1 << 14).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    spark.conf.unset(setting)
    corpus_pipeline.segmentations(spark, docs, folder)
    try:
        seen = [r["bytes"] for r in texts.mapInArrow(sizes, "bytes bigint").collect()]
    finally:
        spark.conf.unset(setting)
    assert sum(seen) >= 8 << 20 and max(seen) < 2 * BLOCK_BYTES


def test_tasks_give_memory_back_at_their_end(monkeypatch):
    order = []
    monkeypatch.setattr(words, "give_back", lambda: order.append("back"))
    task = words.returning(lambda batches: (order.append(b) or b for b in batches))
    assert list(task(iter([1, 2]))) == [1, 2] and order == [1, 2, "back"]


def test_class_counts_in_parts(spark, documents, monkeypatch):
    docs = documents([(i, " ".join(f"a{i}w{j}" for j in range(200))) for i in range(20)]).coalesce(1)

    def label(batch):
        return batch.column("doc_id").to_numpy() % 2

    whole = features.collect_counts(features.class_counts(docs, 2, label), 2)
    monkeypatch.setattr(features, "SENT", 100)
    parts = features.collect_counts(features.class_counts(docs, 2, label), 2)
    assert whole.sum(axis=1).tolist() == [3990.0, 3990.0, 7980.0] and (whole == parts).all()


def test_run_equals_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "ids" in out.columns


def test_registered():
    names = entry_point.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
