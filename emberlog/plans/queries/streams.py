"""Batch twins of the streaming aggregates, and streams run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators.parse import parse_lines
from emberlog.plans import fixtures as fx
from emberlog.plans.queries import EVENTS_SQL, query
from emberlog.session import materialize, scratch_path
from emberlog.streaming import windows
from emberlog.streaming.tail import follow_lines


def _parsed(spark, sf_dir):
    return parse_lines(fx.journald(spark, sf_dir), "syslog")


@query(f"""WITH {EVENTS_SQL},
x AS (SELECT ip AS source_ip, unnest([sec - sec % 30, sec - sec % 30 - 30, sec - sec % 30 - 60]) AS start_sec
      FROM e WHERE event_type = 'error')
SELECT source_ip, start_sec, start_sec + 90 AS end_sec, count(*) AS failures FROM x GROUP BY source_ip, start_sec""")
def sliding_failures(spark, sf_dir):
    return windows.sliding_failures(_parsed(spark, sf_dir)).select(
        "source_ip", F.unix_seconds("window.start").alias("start_sec"), F.unix_seconds("window.end").alias("end_sec"), "failures")


@query(f"""WITH {EVENTS_SQL}
SELECT 'web' || (user_id % 3) AS host, sec - sec % 300 AS start_sec, count(*) AS lines FROM e GROUP BY 1, 2""")
def tumbling_event_rate(spark, sf_dir):
    return windows.line_rate(_parsed(spark, sf_dir)).select(
        "host", F.unix_seconds("window.start").alias("start_sec"), "lines")


_GAP = 6 * 3600


@query(f"""WITH {EVENTS_SQL},
g AS (SELECT ip, sec, CASE WHEN sec - lag(sec) OVER (PARTITION BY ip ORDER BY sec) < {_GAP} THEN 0 ELSE 1 END AS step FROM e),
r AS (SELECT *, sum(step) OVER (PARTITION BY ip ORDER BY sec ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT ip AS source_ip, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS logins FROM r GROUP BY ip, run""")
def login_sessions(spark, sf_dir):
    return windows.login_sessions(_parsed(spark, sf_dir), _GAP)


@query(f"""WITH {EVENTS_SQL}
SELECT 'web' || (user_id % 2) || '.log' AS log, ip AS source_ip, at_text, event_type = 'error' AS failed, count(*) AS lines
FROM e GROUP BY 1, 2, 3, 4""")
def follow_growing_logs(spark, sf_dir):
    """Two logs that grow between three triggers of a stream, each time by lines and half a line: every line comes once, whole."""
    lines = materialize(fx.journald(spark, sf_dir).withColumn("log", F.pmod(F.regexp_extract("raw", r"from 10\.\d+\.\d+\.(\d+) ", 1).cast("int"), F.lit(2))))
    folder, out = scratch_path(spark, "growing"), scratch_path(spark, "followed")
    half = [b"", b""]
    for k in range(3):
        for log in (0, 1):
            part = scratch_path(spark, "part")
            lines.filter((F.col("log") == log) & (F.col("line_no") % 3 == k)).select("raw").write.text(part)
            half[log] = fx.grow(part, f"{folder}/web{log}.log", half[log], 0 if k == 2 else 9)
        stream = follow_lines(spark, folder, split_bytes=1 << 18).writeStream.format("parquet").option("path", out)
        stream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = parse_lines(spark.read.parquet(out).select("source_file", "raw"), "syslog")
    return read.groupBy(
        F.substring_index("source_file", "/", -1).alias("log"), "source_ip", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("at_text"),
        F.contains("message", F.lit("Failed password")).alias("failed")).agg(F.count(F.lit(1)).alias("lines"))
