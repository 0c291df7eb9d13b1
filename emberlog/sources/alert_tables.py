"""Stored alerts and indicators: layout, reading, appending, clearing, JSON export.

Alerts are kept as one folder per feed and batch, partitioned by severity. A feed is one line of batches: batch jobs, one
watch, one scoring job; feeds never touch each other's folders. A batch written again replaces its own folder, so a retried
batch changes nothing, and no stored file is ever rewritten for an upsert: readers keep the newest row per id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import alerts as ops
from emberlog.schema import ALERT, IOC, conform

BATCH, WATCH, MODEL = "batch", "watch", "model"
_STORED = "feed STRING, batch_id BIGINT, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALERT.fields)


def create(spark: SparkSession, path: str) -> None:
    """Empty alert and indicator tables."""
    write_batch(spark.createDataFrame([], ALERT), path, -1)
    write_ioc_delta(spark, path, -1)


def folder(path: str, kind: str, batch_id: int, feed: str = BATCH) -> str:
    """Where a batch of ``kind`` (alerts, iocs, parsed) is kept."""
    return f"{path}/{kind}/feed={feed}/batch_id={batch_id}"


def next_batch(spark: SparkSession, path: str, feed: str = BATCH) -> int:
    """A batch id that nothing in the store has yet, from the names of its folders."""
    jvm = spark.sparkContext._jvm
    taken = jvm.org.apache.hadoop.fs.Path(f"{path}/{{alerts,parsed}}/feed={feed}/batch_id=*")
    found = taken.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(taken) or []
    return 1 + max((int(f.getPath().getName().partition("=")[2]) for f in found), default=-1)


def write_batch(alerts: DataFrame, path: str, batch_id: int, feed: str = BATCH) -> None:
    """Store one batch of alerts; writing the same batch of the same feed again is harmless."""
    shaped = conform(alerts, ALERT)
    shaped.sortWithinPartitions("severity", "generated_at").write.mode("overwrite").partitionBy("severity").parquet(
        folder(path, "alerts", batch_id, feed))


def _newest(stored: DataFrame) -> DataFrame:
    newest = Window.partitionBy("id").orderBy(F.col("batch_id").desc(), F.col("generated_at").desc(), "feed")
    return conform(stored.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1"), ALERT)


def read_alerts(spark: SparkSession, path: str, batch_id: int | None = None, feed: str | None = None) -> DataFrame:
    """Newest row per id over all feeds and batches, or over one."""
    stored = spark.read.schema(_STORED).parquet(f"{path}/alerts")
    if batch_id is not None:
        stored = stored.filter(F.col("batch_id") == batch_id)
    if feed is not None:
        stored = stored.filter(F.col("feed") == feed)
    return _newest(stored)


def compact(spark: SparkSession, path: str) -> None:
    """Write the alerts as they stand as a table of their own, partitioned by severity, for ``read_current``."""
    shaped = read_alerts(spark, path).sortWithinPartitions("severity", "generated_at")
    shaped.write.mode("overwrite").partitionBy("severity").parquet(f"{path}/current")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The alerts as of the last ``compact``: one row per id already, so a report reads only the severities it asks for."""
    return conform(spark.read.schema(ALERT).parquet(f"{path}/current"), ALERT)


def write_ioc_delta(spark: SparkSession, path: str, batch_id: int, feed: str = BATCH) -> None:
    """Indicator counts of one stored batch, kept next to it; replaced when the batch is written again."""
    batch = spark.read.schema(ALERT).parquet(folder(path, "alerts", batch_id, feed))
    ops.ioc_mart(batch).write.mode("overwrite").parquet(folder(path, "iocs", batch_id, feed))


def read_ioc_counters(spark: SparkSession, path: str) -> DataFrame:
    """Running indicator counts over all batches, without reading any alert."""
    stored = spark.read.schema(IOC).parquet(f"{path}/iocs")
    return conform(ops.ioc_merge(stored.limit(0), stored), IOC)


def read_iocs(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of the alerts as they stand now."""
    return conform(ops.ioc_mart(read_alerts(spark, path)), IOC)


def clear(spark: SparkSession, path: str) -> None:
    """Both tables empty again: an empty table replaces all batches."""
    feed = {"feed": F.lit(BATCH), "batch_id": F.lit(-1)}
    empty = spark.createDataFrame([], ALERT).withColumns(feed)
    empty.write.mode("overwrite").partitionBy("feed", "batch_id", "severity").parquet(f"{path}/alerts")
    counters = spark.createDataFrame([], IOC).withColumns(feed)
    counters.write.mode("overwrite").partitionBy("feed", "batch_id").parquet(f"{path}/iocs")


def decode_json_arrays(rows: DataFrame) -> DataFrame:
    """Rows that hold ``iocs`` and ``affected_lines`` as JSON text, with real arrays; missing text is empty."""
    return rows.withColumns({
        c: F.from_json(F.coalesce(F.col(c), F.lit("[]")), "array<string>") for c in ("iocs", "affected_lines")})


def export_json(alerts: DataFrame, path: str) -> None:
    """One JSON object per alert with the exported keys; keys without a value are written as null."""
    ops.export_rows(alerts).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
