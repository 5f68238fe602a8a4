import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reviewmill import scale
from reviewmill.operators.windows import dated, in_window
from reviewmill.schemas import REVIEW
from reviewmill.sources import storage, tables

DAY = dt.date(2026, 8, 30)


def reviews(spark, days, product="p", text="t"):
    rows = [(product, f"{i:012x}", "play_store", DAY - dt.timedelta(days=d), 3, "", f"{text}{i}", None) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, REVIEW)


def test_reviews_round_trip_and_replace_their_days(spark, tmp_path):
    path = str(tmp_path / "reviews")
    storage.write_reviews(reviews(spark, [0, 1, 1, 5]).withColumn("more", F.lit(1)), path)
    storage.write_reviews(reviews(spark, [1], text="new"), path)
    back = tables.load_reviews(spark, path)
    assert back.columns == reviews(spark, [0]).columns
    assert sorted((r.date, r.text) for r in back.collect()) == [
        (DAY - dt.timedelta(days=5), "t3"), (DAY - dt.timedelta(days=1), "new0"), (DAY, "t0")
    ]


def test_writing_a_product_keeps_the_others(spark, tmp_path, monkeypatch):
    """Also those of its own bucket and day, read from the touched folders alone."""
    path = str(tmp_path / "reviews")
    products = [f"p{i}" for i in range(40)]
    first = reviews(spark, [0, 1], products[0])
    for product in products[1:]:
        first = first.union(reviews(spark, [0, 1], product))
    storage.write_reviews(first, path)
    plans = []
    cut = storage.cut_lineage
    monkeypatch.setattr(storage, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    storage.write_reviews(reviews(spark, [1], "p7", "new"), path)
    back = sorted((r.product_id, r.date, r.text) for r in tables.load_reviews(spark, path).collect())
    yesterday = DAY - dt.timedelta(days=1)
    assert back == sorted([(p, DAY, "t0") for p in products] + [(p, yesterday, "new0" if p == "p7" else "t1") for p in products])
    filters = plans[-1].split("PartitionFilters")[1]
    assert "2026-08-29" in filters and "2026-08-30" not in filters.split("PushedFilters")[0] and "bucket" in filters
    storage.write_reviews(first.limit(0), path)
    assert tables.load_reviews(spark, path).count() == 80


def test_window_scans_read_only_their_days(spark, tmp_path):
    path = str(tmp_path / "reviews")
    storage.write_reviews(reviews(spark, range(60)), path)
    windows = spark.createDataFrame(
        [("p", DAY, DAY - dt.timedelta(days=6), DAY)], "product_id string, week_ending date, reporting_from date, reporting_to date"
    )
    found = in_window(tables.load_reviews(spark, path), windows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2026-08-24" in plan.split("PartitionFilters")[1]
    assert found.count() == 7
    none = dated(tables.load_reviews(spark, path), windows.limit(0), F.col("reporting_from"), F.col("reporting_to"))
    assert none.count() == 0


def test_archive_write_reads_only_its_weeks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    empty = storage.load_archive(spark, path)

    def report(product, week):
        values = {"product_id": product, "week_ending": week}
        columns = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
        return spark.range(1).select(*columns)

    weeks = [DAY - dt.timedelta(days=7 * i) for i in range(3)]
    for week in weeks:
        storage.archive_reports(report("a", week).union(report("b", week)), path)
    plans = []
    cut = storage.cut_lineage
    monkeypatch.setattr(storage, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    storage.archive_reports(report("a", weeks[1]), path)
    assert any("PartitionFilters" in p and str(weeks[1]) in p for p in plans)
    kept = sorted((r.product_id, r.week_ending) for r in storage.load_archive(spark, path).collect())
    assert kept == sorted((p, w) for p in "ab" for w in weeks)


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    assert storage.load_archive(spark, str(tmp_path / "none")).isEmpty()
    assert tables.load_registry(spark, str(tmp_path / "none")).isEmpty()


def test_other_errors_surface(spark, monkeypatch):
    class Broken:
        def schema(self, _):
            return self

        def parquet(self, _):
            raise AnalysisException("access denied")

    class Session:
        read = Broken()

    for load in (storage.load_archive, tables.load_registry):
        with pytest.raises(AnalysisException):
            load(Session(), "anywhere")


def test_small_writers(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1)], "product_id string, n int")
    storage.write_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).collect() == rows.collect()
    storage.write_report_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().n == 1
    for _ in range(2):
        storage.append_validation(rows, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_small_sides_leave_nothing_cached(spark):
    big, small = spark.range(100).withColumn("k", F.col("id") % 5), spark.range(5).toDF("k")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    joined = scale.attach_small(big, small, ["k"])
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 100
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    wide = scale.attach_small(big.hint("merge"), small, ["k"], max_bytes=10)
    assert wide.count() == 100


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,512]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        scale.ensure_checkpoint_dir(Session())
