"""Line scans, samples and format detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import detect_format as detect
from emberlog.operators.formats import jsonl
from emberlog.operators.parse import parse_corpus
from emberlog.plans import fixtures as fx
from emberlog.plans.queries import query
from emberlog.session import scratch_path
from emberlog.sources.lines import number_lines, sample_lines, scan_lines


def _written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, one folder per source, and scanned back."""
    path = scratch_path(spark, "documents")
    fx.table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(path)
    return scan_lines(spark, path).withColumn("source", F.regexp_extract("source_file", "source=([^/]+)", 1))


_LINES = "SELECT source, unnest(string_split(text, chr(10))) AS raw FROM documents"


@query(f"""
SELECT source, count(*) AS n_lines, CAST(sum(length(raw)) AS BIGINT) AS n_chars
FROM ({_LINES}) WHERE regexp_matches(raw, '\\S') GROUP BY source""")
def scan_nonblank_lines(spark, sf_dir):
    return _written_documents(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"))


@query(f"""
SELECT source, count(*) AS n_lines, count(*) AS n_numbers
FROM ({_LINES}) WHERE regexp_matches(raw, '\\S') GROUP BY source""")
def number_scanned_lines(spark, sf_dir):
    """Line numbers are dense in every file: the highest numbers add up to the line count."""
    numbered = number_lines(_written_documents(spark, sf_dir).drop("source"))
    files = numbered.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("top"))
    source = F.regexp_extract("source_file", "source=([^/]+)", 1).alias("source")
    return files.groupBy(source).agg(F.sum("n").alias("n_lines"), F.sum("top").alias("n_numbers"))


@query("""
WITH r AS (SELECT source, doc_id, text,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
           FROM documents WHERE regexp_matches(text, '\\S'))
SELECT source AS source_file, rn AS sample_no, CAST(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS n_chars
FROM r WHERE rn <= 20""")
def format_sample(spark, sf_dir):
    lines = fx.documents_as_lines(spark, sf_dir).filter(F.col("raw").rlike(r"\S"))
    return sample_lines(lines.select("source_file", "line_no", "raw")).select(
        "source_file", F.col("sample_no").cast("bigint").alias("sample_no"),
        F.length("raw").cast("bigint").alias("n_chars"))


# The first lines of each rendered file decide its scores; json lines come in six shapes, four of them objects.
_SCORES = """
VALUES ('bsd.log', 1.0, 0.0, 0.0, 0.0, 'syslog'), ('journald.log', 1.0, 0.0, 0.0, 0.0, 'syslog'),
       ('rfc5424.log', 1.0, 0.0, 0.0, 0.0, 'syslog'), ('clf.log', 0.0, 1.0, 0.0, 0.0, 'clf'),
       ('viewer.csv', 0.0, 0.0, 0.0, 1.0, 'windows_csv'), ('shell.csv', 0.0, 0.0, 0.0, 1.0, 'windows_csv')"""
_FILES = f"""
s AS (
  SELECT * FROM ({_SCORES}) t(source_file, syslog, clf, json, windows_csv, format)
  UNION ALL
  SELECT 'app.jsonl', 0.0, 0.0, avg(CASE WHEN event_id % 6 < 4 THEN 1.0 ELSE 0.0 END), 0.0, 'json'
  FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 20)
  UNION ALL SELECT 'notes.txt', 0.0, 0.0, 0.0, 0.0, 'unknown'
)"""


@query(f"""WITH {_FILES}
SELECT source_file, CAST(syslog AS DOUBLE) AS syslog, CAST(clf AS DOUBLE) AS clf, CAST(json AS DOUBLE) AS json,
       CAST(windows_csv AS DOUBLE) AS windows_csv FROM s""")
def format_scores(spark, sf_dir):
    return detect.format_scores(sample_lines(fx.mixed(spark, sf_dir)))


@query(f"WITH {_FILES} SELECT source_file, format FROM s")
def detect_format_per_file(spark, sf_dir):
    return detect.detect_formats(fx.mixed(spark, sf_dir)).select("source_file", "format")


@query("""
WITH d AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS raw FROM documents)
           WHERE regexp_matches(raw, '\\S')),
c AS (SELECT count(*) AS n, count(*) FILTER (event_id % 6 < 4) AS objects,
             count(*) FILTER (user_id % 2 = 1) AS shell,
             count(*) FILTER (user_id % 2 = 1 AND event_id % 20 <> 0) AS shell_good,
             count(*) FILTER (user_id % 2 = 0) AS viewer,
             count(*) FILTER (user_id % 2 = 0 AND event_id % 20 <> 0) AS viewer_good FROM events)
SELECT 'bsd.log' AS source_file, 'syslog' AS format, n AS n FROM c
UNION ALL SELECT 'journald.log', 'syslog', n FROM c
UNION ALL SELECT 'rfc5424.log', 'syslog', n FROM c
UNION ALL SELECT 'clf.log', 'clf', n FROM c
UNION ALL SELECT 'app.jsonl', 'json', objects FROM c
UNION ALL SELECT 'app.jsonl', 'unknown', n - objects FROM c
UNION ALL SELECT 'shell.csv', 'windows_csv', shell_good + 1 FROM c
UNION ALL SELECT 'shell.csv', 'unknown', shell - shell_good FROM c
UNION ALL SELECT 'viewer.csv', 'windows_csv', viewer_good + 1 FROM c
UNION ALL SELECT 'viewer.csv', 'unknown', viewer - viewer_good FROM c
UNION ALL SELECT 'notes.txt', 'unknown', n FROM d""")
def parse_mixed_corpus(spark, sf_dir):
    parsed = parse_corpus(fx.mixed(spark, sf_dir))
    return parsed.groupBy("source_file", "format").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id AS line_no, event_id % 6 < 4 AS is_object FROM events""")
def json_strict_objects(spark, sf_dir):
    return fx.json_lines(spark, sf_dir).select(
        "line_no", jsonl.fields(F.col("raw")).isNotNull().alias("is_object"))


@query("""
SELECT event_id AS line_no, CASE WHEN event_id % 20 = 0 THEN 'unknown' ELSE 'windows_csv' END AS format FROM events
UNION ALL SELECT -1, 'windows_csv' FROM (SELECT DISTINCT user_id % 2 FROM events)""")
def wincsv_scan_ragged(spark, sf_dir):
    return parse_corpus(fx.windows_csv(spark, sf_dir), "windows_csv").select("line_no", "format")


@query("""
WITH d AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS raw FROM documents)
           WHERE regexp_matches(raw, '\\S')),
c AS (SELECT count(*) AS n, count(DISTINCT user_id % 2) AS heads FROM events)
SELECT d.n + 6 * c.n + c.heads AS lines_in, d.n + 6 * c.n + c.heads AS rows_out FROM c, d""")
def parse_rowcount_invariant(spark, sf_dir):
    lines = fx.mixed(spark, sf_dir)
    before = lines.agg(F.count(F.lit(1)).alias("lines_in"))
    after = parse_corpus(lines).agg(F.count("message"))
    return before.withColumn("rows_out", after.scalar())
