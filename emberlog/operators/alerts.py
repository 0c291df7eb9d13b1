"""Alert and indicator tables: queries, upserts, exports and summaries."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import ioc_type, rank_of, severity_rank
from emberlog.schema import EXPORT_KEYS, SEVERITIES, UNRANKED

# --- fixed values -----------------------------------------------------------------
TEXT_LIMIT = 50
RECENT_LIMIT = 20
TOP_IOCS = 10
DIGEST_LINES = 3
DIGEST_LINE_CHARS = 120
DIGEST_DESCRIPTION_CHARS = 100
# ----------------------------------------------------------------------------------


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("generated_at").desc(), "id")


def count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("n"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def severity_table(alerts: DataFrame) -> DataFrame:
    """Counts from CRITICAL to INFO; severities without alerts do not appear."""
    return severity_counts(alerts).orderBy(severity_rank(F.col("severity")))


def rollup(alerts: DataFrame) -> DataFrame:
    """Counts per source and severity, per source, and in total."""
    return alerts.rollup("source_file", "severity").agg(F.count(F.lit(1)).alias("n"))


def at_least(alerts: DataFrame, min_severity: str) -> DataFrame:
    """Alerts of at least a severity. An unknown name keeps every known severity, as no rank is above it.

    Written as a list of names, so the filter reaches the scan and prunes a table partitioned by severity.
    """
    limit = rank_of(min_severity)
    if limit == UNRANKED:
        warnings.warn(f"unknown severity {min_severity!r}: nothing is filtered", stacklevel=2)
    return alerts.filter(F.col("severity").isin([s for i, s in enumerate(SEVERITIES) if i <= limit]))


def by_severity(alerts: DataFrame, min_severity: str) -> DataFrame:
    return _newest_first(at_least(alerts, min_severity))


def _contains(text: Column, term: str) -> Column:
    """Substring test that folds only ASCII letters; ``%`` and ``_`` are ordinary characters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = term.translate(str.maketrans(upper, lower))
    return F.translate(text, upper, lower).contains(folded)


def by_text(alerts: DataFrame, term: str, limit: int = TEXT_LIMIT) -> DataFrame:
    """Newest alerts with ``term`` in title, description or an indicator."""
    hit = (
        _contains(F.col("title"), term) | _contains(F.col("description"), term)
        | F.exists("iocs", lambda i: _contains(i, term))
    )
    return _newest_first(alerts.filter(hit)).limit(limit)


def by_ioc(alerts: DataFrame, value: str) -> DataFrame:
    return _newest_first(alerts.filter(F.array_contains("iocs", value)))


def by_source(alerts: DataFrame, source_file: str) -> DataFrame:
    return _newest_first(alerts.filter(F.col("source_file") == source_file))


def recent(alerts: DataFrame, n: int = RECENT_LIMIT) -> DataFrame:
    return _newest_first(alerts).limit(n)


def upsert(current: DataFrame, new: DataFrame, version: str = "generated_at") -> DataFrame:
    """One whole row per id: rows of ``new`` win, later versions first among them.

    The rank filter also runs before the shuffle, so many copies of one id leave each task as one row.
    """
    both = current.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    newest = Window.partitionBy("id").orderBy(F.col("_batch").desc(), F.col(version).desc())
    return both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_batch")


def ioc_mart(alerts: DataFrame) -> DataFrame:
    """Per indicator value: type, first and last time, number of occurrences (repeats in one alert count)."""
    return (
        alerts.select("generated_at", F.explode("iocs").alias("value"))
        .groupBy("value")
        .agg(F.min("generated_at").alias("first_seen"), F.max("generated_at").alias("last_seen"),
             F.count(F.lit(1)).alias("alert_count"))
        .select("value", ioc_type(F.col("value")).alias("type"), "first_seen", "last_seen", "alert_count")
    )


def ioc_merge(mart: DataFrame, delta: DataFrame) -> DataFrame:
    """Two indicator marts as one; equal values add up."""
    return (
        mart.unionByName(delta)
        .groupBy("value")
        .agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
             F.sum("alert_count").alias("alert_count"))
        .select("value", ioc_type(F.col("value")).alias("type"), "first_seen", "last_seen", "alert_count")
    )


def top_iocs(mart: DataFrame, n: int = TOP_IOCS) -> DataFrame:
    return mart.orderBy(F.col("alert_count").desc(), "value").limit(n)


def ioc_count(mart: DataFrame) -> DataFrame:
    """The mart has one row per value, so a row count is the distinct count."""
    return mart.agg(F.count(F.lit(1)).alias("n"))


def store_stats(alerts: DataFrame, mart: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: alerts, counts by severity (map), distinct indicators, chunks."""
    by_name = severity_counts(alerts).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    return by_name.withColumns({
        "ioc_count": ioc_count(mart).scalar(),
        "chunks_analyzed": chunks.agg(F.count(F.lit(1))).scalar(),
    })


def _iso(ts: Column) -> Column:
    """ISO text, with microseconds only where there are any."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def export_rows(alerts: DataFrame) -> DataFrame:
    """The exported keys in order, times as ISO text."""
    shaped = alerts.withColumns({c: _iso(F.col(c)) for c in ("timestamp_first", "timestamp_last", "generated_at")})
    return shaped.select(*EXPORT_KEYS)


def digest(alerts: DataFrame) -> DataFrame:
    """Text parts of an alert as shown to a reader: short lines, first indicators, time to the second."""
    lines, iocs = F.col("affected_lines"), F.col("iocs")
    n_lines, n_iocs = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(iocs), F.lit(0))
    return alerts.select(
        "id",
        "severity",
        "title",
        F.left(F.coalesce("description", F.lit("")), F.lit(DIGEST_DESCRIPTION_CHARS)).alias("description"),
        F.array_join(F.transform(F.slice(lines, 1, DIGEST_LINES), lambda x: F.left(x, F.lit(DIGEST_LINE_CHARS))), "\n")
        .alias("lines"),
        F.when(n_lines > DIGEST_LINES, F.concat(F.lit("... "), (n_lines - DIGEST_LINES).cast("string"), F.lit(" more")))
        .alias("more_lines"),
        F.when(n_iocs == 0, "none").otherwise(F.concat(
            F.array_join(F.slice(iocs, 1, 3), ", "), F.when(n_iocs > 3, "…").otherwise(""))).alias("iocs"),
        F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
    )


def remediation_plan(alerts: DataFrame) -> DataFrame:
    """Suggested commands as text, the undo command only where the step is reversible. Nothing is run."""
    r = F.col("remediation")
    return alerts.filter(r["command"] != "").select(
        "id",
        r["action"].alias("action"),
        r["command"].alias("command"),
        F.when(r["reversible"] & (r["undo_command"] != ""), r["undo_command"]).alias("undo"),
    )
