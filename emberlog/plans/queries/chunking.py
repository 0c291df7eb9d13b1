"""Token budgets, chunks and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.scalars import token_estimate
from emberlog.operators import budget, chunks
from emberlog.plans import fixtures as fx
from emberlog.plans.queries import query


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate_documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


_CONV = """c AS (
  SELECT conv_id, CAST(sum(greatest(1, length(text) // 4) + 4) AS BIGINT) AS tokens,
         coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS summary
  FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, tokens,
             tokens + CASE WHEN summary <> '' THEN greatest(1, length(summary) // 4) ELSE 0 END AS used FROM c)"""
BUDGET = 1000


def _conversations(spark, sf_dir):
    """Tokens per conversation; its first answer stands for the summary."""
    rows = fx.table(spark, sf_dir, "conversations")
    told = F.when(F.col("role") == "assistant", F.col("turn"))
    return rows.groupBy("conv_id").agg(
        F.sum(budget.message_tokens(F.col("text"))).alias("tokens"), F.min_by("text", told).alias("summary"))


@query(f"WITH {_CONV} SELECT conv_id, tokens FROM c")
def conversation_tokens(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", "tokens")


@query(f"WITH {_CONV} SELECT conv_id, CAST(used AS BIGINT) AS used FROM u")
def conversation_used(spark, sf_dir):
    return _conversations(spark, sf_dir).select(
        "conv_id", budget.used(F.col("tokens"), F.col("summary")).alias("used"))


@query(f"WITH {_CONV} SELECT conv_id, round(used / {BUDGET}, 6) AS fraction FROM u")
def conversation_fraction(spark, sf_dir):
    return _conversations(spark, sf_dir).select(
        "conv_id", F.round(budget.fraction_used(F.col("tokens"), BUDGET, F.col("summary")), 6).alias("fraction"))


@query(f"WITH {_CONV} SELECT conv_id FROM u WHERE used >= 0.75 * {BUDGET}")
def conversations_over_budget(spark, sf_dir):
    return _conversations(spark, sf_dir).filter(
        budget.is_over_threshold(F.col("tokens"), BUDGET, F.col("summary"))).select("conv_id")


# The sequential rule itself, one row at a time.
_CHUNKS = """WITH RECURSIVE n AS (
  SELECT source, doc_id, text, lang, greatest(1, length(text) // 4) AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
g AS (
  SELECT source, doc_id, rn, t, CAST(0 AS BIGINT) AS c, t AS filled FROM n WHERE rn = 1
  UNION ALL
  SELECT n.source, n.doc_id, n.rn, n.t, CASE WHEN g.filled + n.t > 1500 THEN g.c + 1 ELSE g.c END,
         CASE WHEN g.filled + n.t > 1500 THEN n.t ELSE g.filled + n.t END
  FROM g JOIN n ON n.source = g.source AND n.rn = g.rn + 1)
"""


def _chunked(spark, sf_dir):
    return chunks.assign_chunks(fx.documents_as_lines(spark, sf_dir))


@query(_CHUNKS + "SELECT source AS source_file, doc_id AS line_no, CAST(t AS BIGINT) AS tokens, c AS chunk_index FROM g")
def chunk_assign(spark, sf_dir):
    return _chunked(spark, sf_dir).select("source_file", "line_no", "tokens", "chunk_index")


@query(_CHUNKS + "SELECT source AS source_file, max(c) + 1 AS n_chunks FROM g GROUP BY source")
def chunk_counts(spark, sf_dir):
    lines = fx.documents_as_lines(spark, sf_dir).select("source_file", "line_no", "raw")
    starts = chunks.chunk_starts(lines.withColumn("tokens", token_estimate(F.col("raw"))))
    return starts.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(_CHUNKS + """
SELECT g.source AS source_file, c AS chunk_index, md5(string_agg(n.text, chr(10) ORDER BY g.doc_id)) AS text_hash,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(g.t) AS BIGINT) AS tokens,
       CAST(min(CASE WHEN g.doc_id % 4 <> 0 THEN g.doc_id * 60 END) AS BIGINT) AS first_sec,
       CAST(max(CASE WHEN g.doc_id % 4 <> 0 THEN g.doc_id * 60 END) AS BIGINT) AS last_sec,
       CASE min(g.doc_id) % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'syslog' ELSE 'json' END AS log_format
FROM g JOIN n USING (source, doc_id) GROUP BY g.source, c""")
def chunk_rollup(spark, sf_dir):
    return chunks.chunk_table(_chunked(spark, sf_dir)).select(
        "source_file", "chunk_index", F.md5("chunk_text").alias("text_hash"), "n_lines", "tokens",
        F.unix_seconds("timestamp_first").alias("first_sec"), F.unix_seconds("timestamp_last").alias("last_sec"),
        "log_format")


def _label_alerts(spark, sf_dir):
    """Labelled documents as alerts of their source."""
    severity = F.when(F.col("toxic") == 1, "HIGH").when(F.col("quality") == 0, "LOW").otherwise("INFO")
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"))
    return fx.table(spark, sf_dir, "labels").join(docs, "doc_id").select("source_file", severity.alias("severity"))


_SESSIONS = _CHUNKS + """, a AS (
  SELECT source, count(*) FILTER (toxic = 1) AS high, count(*) FILTER (toxic <> 1 AND quality = 0) AS low,
         count(*) FILTER (toxic <> 1 AND quality <> 0) AS info
  FROM labels JOIN documents USING (doc_id) GROUP BY source),
s AS (
  SELECT g.source AS source_file,
         arg_min(CASE WHEN doc_id % 3 = 1 THEN 'syslog' ELSE 'json' END, doc_id) FILTER (doc_id % 3 <> 0) AS log_format,
         count(*) AS total_lines, max(c) + 1 AS total_chunks, coalesce(any_value(a.high), 0) AS high,
         coalesce(any_value(a.low), 0) AS low, coalesce(any_value(a.info), 0) AS info
  FROM g LEFT JOIN a USING (source) GROUP BY g.source)
"""


@query(_SESSIONS + """
SELECT source_file, log_format, total_lines, total_chunks, CAST(0 AS BIGINT) AS critical, high,
       CAST(0 AS BIGINT) AS medium, low, info, high + low + info AS total_alerts FROM s""")
def session_rollup(spark, sf_dir):
    return chunks.session_table(_chunked(spark, sf_dir), _label_alerts(spark, sf_dir))


@query(_SESSIONS + """
SELECT source_file, source_file || ' | ' || coalesce(log_format, '') || ' | ' || total_lines || ' lines | '
  || total_chunks || ' chunks | ' || coalesce(nullif(concat_ws(', ',
       CASE WHEN high > 0 THEN high || ' high' END, CASE WHEN low > 0 THEN low || ' low' END,
       CASE WHEN info > 0 THEN info || ' info' END), ''), 'no alerts') AS summary FROM s""")
def session_summary_line(spark, sf_dir):
    return chunks.summary_line(
        chunks.session_table(_chunked(spark, sf_dir), _label_alerts(spark, sf_dir))).select("source_file", "summary")
