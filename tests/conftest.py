import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4)
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate an expression over text values, in order."""
    from pyspark.sql import functions as F

    def run(items, body, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
        return [r.out for r in rows.select("i", body(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
