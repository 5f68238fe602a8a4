"""Join and materialisation helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes a side may have before it is no longer broadcast: its rows as text, and what a row of a
# hash table takes besides.
SMALL_SIDE_BYTES = 64 << 20
ROW_BYTES = 64


def attach_small(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_bytes: int = SMALL_SIDE_BYTES,
) -> DataFrame:
    """Join a per-key table to a large one without shuffling the large side.

    The small side is stored first, so it is computed once and its size is known; it is broadcast
    only while its rows take at most ``max_bytes``. Beyond that the join is left to Spark, where
    adaptive execution splits a hot key. Nothing stays in executors' memory.
    """
    small = cut_lineage(small)
    size = small.agg(F.sum(F.length(F.to_json(F.struct(*small.columns))) + ROW_BYTES)).first()[0] or 0
    return big.join(F.broadcast(small) if size <= max_bytes else small, list(on), how)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the cluster's shared folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written as a table into the folder of checkpoints and read back.

    Like ``cut_lineage``, but later steps read only the columns they use. The folder stays until the
    cluster clears its checkpoints.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="reviewmill-"))
