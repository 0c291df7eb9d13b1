"""Event-time aggregates that run on a stream or on a stored table.

On a stream, rows later than the watermark are dropped and windows are emitted once the watermark has passed them; on a
stored table the watermark has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.scalars import epoch_second
from emberlog.operators.detectors import login_failed, login_succeeded
from emberlog.operators.slices import islands, per_second

WATERMARK = "5 minutes"


def sliding_failures(parsed: DataFrame, size: str = "90 seconds", slide: str = "30 seconds",
                     watermark: str = WATERMARK) -> DataFrame:
    """Failed logins per source in sliding windows."""
    failed = parsed.filter(login_failed() & F.col("source_ip").isNotNull()).withWatermark("event_ts", watermark)
    return failed.groupBy("source_ip", F.window("event_ts", size, slide)).agg(F.count(F.lit(1)).alias("failures"))


def line_rate(parsed: DataFrame, size: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Lines per host in fixed windows."""
    timed = parsed.filter("event_ts IS NOT NULL").withWatermark("event_ts", watermark)
    return timed.groupBy("host", F.window("event_ts", size)).agg(F.count(F.lit(1)).alias("lines"))


def _logins(parsed: DataFrame) -> DataFrame:
    return parsed.filter(
        (login_failed() | login_succeeded()) & F.col("source_ip").isNotNull() & F.col("event_ts").isNotNull())


def login_sessions(parsed: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """Login sessions per source of a stored table; a session ends at a gap of ``gap_seconds`` or more."""
    seconds = per_second(_logins(parsed), ["source_ip"], epoch_second(F.col("event_ts")), logins=F.count(F.lit(1)))
    return islands(seconds, ["source_ip"], gap_seconds, logins=(F.sum, "logins"))


def login_sessions_stream(parsed: DataFrame, gap_seconds: int = 600, watermark: str = WATERMARK) -> DataFrame:
    """The same on a stream."""
    return (
        _logins(parsed).withColumn("event_ts", F.date_trunc("second", "event_ts"))
        .withWatermark("event_ts", watermark)
        .groupBy("source_ip", F.session_window("event_ts", f"{gap_seconds} seconds"))
        .agg(F.unix_seconds(F.min("event_ts")).alias("first_sec"), F.unix_seconds(F.max("event_ts")).alias("last_sec"),
             F.count(F.lit(1)).alias("logins"))
        .select("source_ip", "first_sec", "last_sec", "logins")
    )


def dedupe_alerts(alerts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Drop replayed alerts of the same id; on a stream only within the watermark, so state stays bounded."""
    if alerts.isStreaming:
        return alerts.withWatermark("generated_at", watermark).dropDuplicatesWithinWatermark(["id"])
    return alerts.dropDuplicates(["id"])


def success_after_failures_stream(parsed: DataFrame, window_seconds: int = 3600, min_failures: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Logins that succeed within ``window_seconds`` after failures of the same source: source_ip, first_sec, last_sec, n.

    The stream is joined with itself on the source and an interval of time. Both sides are combined per second first, so a source
    keeps at most a row per second, and only for as long as a success can still come. A success is emitted once the watermark
    has passed it.
    """
    def seconds(name: str) -> DataFrame:
        # both sides see all logins, so time goes on alike on both
        counts = F.count_if(login_failed()).alias("failed_n"), F.count_if(login_succeeded()).alias("ok_n")
        per = _logins(parsed).withWatermark("event_ts", watermark).groupBy("source_ip", F.window("event_ts", "1 second")).agg(*counts)
        return per.filter(F.col(f"{name}_n") > 0).select(F.col("source_ip").alias(f"{name}_ip"), F.window_time("window").alias(f"{name}_at"), f"{name}_n")

    failed, ok = seconds("failed"), seconds("ok")
    near = (F.col("failed_ip") == F.col("ok_ip")) & (F.col("failed_at") < F.col("ok_at")) & (
        F.col("failed_at") >= F.col("ok_at") - F.expr(f"INTERVAL {window_seconds} SECONDS"))
    after = failed.join(ok, near).groupBy("ok_ip", F.window("ok_at", "1 second")).agg(F.sum("failed_n").alias("n"), F.min("failed_at").alias("since"))
    return after.filter(F.col("n") >= min_failures).select(
        F.col("ok_ip").alias("source_ip"), F.unix_seconds("since").alias("first_sec"), F.unix_seconds("window.start").alias("last_sec"), "n")
