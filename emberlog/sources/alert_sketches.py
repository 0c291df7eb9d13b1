"""Mergeable summaries of indicators: a row per batch, from which counts over any batches are merged without reading alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import ALERT
from emberlog.sources.alert_tables import BATCH, folder

#: Registers of the distinct-count sketch, as a power of two, and values that the frequency sketch tracks.
REGISTERS, TRACKED = 14, 10_000
#: A distinct count is off by more than this share in about one of four hundred cases: three times 1.04 / sqrt(2 ** REGISTERS).
DISTINCT_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2)


def write_sketches(spark: SparkSession, path: str, batch_id: int, feed: str = BATCH) -> None:
    """Summarise the indicators of one stored batch next to it; summarising it again replaces its row."""
    alerts = spark.read.schema(ALERT).parquet(folder(path, "alerts", batch_id, feed))
    named = alerts.select(F.explode("iocs").alias("value")).filter("value IS NOT NULL")
    row = named.agg(F.count(F.lit(1)).alias("occurrences"), F.hll_sketch_agg("value", REGISTERS).alias("distinct"),
                    F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("frequent"))
    row.filter("occurrences > 0").write.mode("overwrite").parquet(folder(path, "sketches", batch_id, feed))


def read_sketches(spark: SparkSession, path: str, k: int = 10, feed: str | None = None) -> DataFrame:
    """One row over all batches, or those of one feed: occurrences, distinct_iocs, top (array of value and count, most first).

    Occurrences in rows of an alert stored again count again, as in ``read_ioc_counters``. ``distinct_iocs`` is within
    DISTINCT_ERROR; a count in ``top`` is too high by no more than occurrences / TRACKED times 2, and exact while no batch has more
    values than three quarters of TRACKED. No row if there is no indicator.
    """
    frequent = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
    stored = spark.read.schema(f"feed string, batch_id bigint, occurrences bigint, distinct binary, frequent {frequent}").parquet(f"{path}/sketches")
    if feed is not None:
        stored = stored.filter(F.col("feed") == feed)
    merged = stored.agg(F.sum("occurrences").alias("occurrences"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_iocs"),
                        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {TRACKED}), {k})").alias("top"))
    return merged.filter("occurrences IS NOT NULL").withColumn("top", F.transform("top", lambda t: F.struct(t["item"].alias("value"), t["count"].alias("n"))))
