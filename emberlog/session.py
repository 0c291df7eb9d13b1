"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions sent to Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["emberlog"])

# A side is broadcast only after it has been measured to be within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone (naive log times are taken as UTC) and adaptive execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A missing dictionary key or array slot is a null here, never a failed job.
    spark.conf.set("spark.sql.legacy.sizeOfNull", "false")
    # Of a key given twice in an object the last one counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Python workers get rows by size as well as by number, so long texts do not add up.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def fix_splits(spark: SparkSession) -> None:
    """Make two reads of the same files cut them alike, whatever executors come or go between them.

    Split sizes follow the default parallelism of the moment unless a minimum number of partitions is set.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberlog-"))
        current = sc.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, visible to every executor."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder so reuse costs a read and survives lost executors."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is within the bounds, by counting rows and the size of their text; reads one row past the bound."""
    width = F.octet_length(F.to_json(F.struct(*df.columns)))
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
    row = size.first()
    return row["rows"] <= max_rows and row["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it; otherwise leave a shuffle join to the optimizer.

    Pass a table that is cheap to read twice (a checkpoint or a stored table).
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
