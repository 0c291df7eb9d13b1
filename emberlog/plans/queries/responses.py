"""Requests for chunks and findings read from responses."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from emberlog.operators import findings, requests
from emberlog.plans import fixtures as fx
from emberlog.plans.analyze import score_requests
from emberlog.plans.queries import query

# Assistant turns by response shape: 0 one object, 1 text item, 2 no JSON, 3 nothing, 4 text, object and number, 5 two objects.
_R = """WITH r AS (
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS source_file, turn AS chunk_index, text, conv_id, turn,
         (conv_id + turn) % 6 AS kind
  FROM conversations WHERE role = 'assistant'),
f AS (  -- every object found, by position
  SELECT *, 0 AS pos, kind <> 4 AS is_full FROM r WHERE kind IN (0, 4, 5)
  UNION ALL SELECT *, 1, false FROM r WHERE kind = 5)
"""


def _read(spark, sf_dir):
    return findings.read_responses(fx.responses(spark, sf_dir))


def _found(spark, sf_dir):
    return _read(spark, sf_dir).select("source_file", "chunk_index", F.posexplode("items").alias("pos", "item"))


@query(_R + """
SELECT source_file, chunk_index, CASE kind WHEN 2 THEN 'No answer: ' || text
  ELSE '{' END AS start FROM r""")
def response_cleanup(spark, sf_dir):
    clean = findings.cleanup(F.col("response"))
    return fx.responses(spark, sf_dir).select(
        "source_file", "chunk_index",
        F.when(clean.startswith("{"), "{").otherwise(clean).alias("start"))


@query(_R + """
SELECT source_file, chunk_index, 'INFO' AS severity, 'Analysis error' AS title,
       'LLM response was not valid JSON: ' || left('No answer: ' || text, 300) AS description FROM r WHERE kind = 2""")
def response_error_alerts(spark, sf_dir):
    alerts = findings.alerts_from_responses(fx.responses(spark, sf_dir))
    return alerts.filter(F.col("title") == findings.ERROR_TITLE).select(
        "source_file", "chunk_index", "severity", "title", "description")


@query(_R + "SELECT source_file, chunk_index, left(text, 30) || '|second' AS lines FROM r WHERE kind = 2")
def error_alert_rows(spark, sf_dir):
    """Error alerts quote the first lines of their chunk and carry no times."""
    alerts = findings.alerts_from_responses(fx.responses(spark, sf_dir))
    return alerts.filter(
        (F.col("title") == findings.ERROR_TITLE) & F.col("timestamp_first").isNull() & F.col("timestamp_last").isNull()
    ).select("source_file", "chunk_index", F.array_join("affected_lines", "|").alias("lines"))


@query(_R + """
SELECT source_file, chunk_index, CAST(CASE kind WHEN 5 THEN 2 WHEN 0 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS n_items,
       CASE kind WHEN 0 THEN left(text, 20) WHEN 1 THEN left(text, 20) WHEN 3 THEN 'quiet' WHEN 5 THEN 'both' ELSE '' END AS summary
FROM r""")
def parse_findings(spark, sf_dir):
    return _read(spark, sf_dir).select(
        "source_file", "chunk_index", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.col("chunk_summary").alias("summary"))


@query(_R + """
SELECT source_file, chunk_index, CAST(pos AS BIGINT) AS pos, CASE WHEN is_full THEN 'HIGH' ELSE 'INFO' END AS severity
FROM f""")
def finding_severity_norm(spark, sf_dir):
    """Positions count objects only."""
    return _found(spark, sf_dir).select(
        "source_file", "chunk_index", F.col("pos").cast("bigint").alias("pos"),
        findings.severity(F.col("item")).alias("severity"))


@query(_R + """
SELECT source_file, chunk_index, CASE WHEN is_full THEN left(text, 80) ELSE 'Unknown threat' END AS title,
       CASE WHEN is_full THEN text ELSE 'd' END AS description, CASE WHEN is_full THEN 'r' ELSE '' END AS recommendation,
       CASE WHEN is_full THEN '10.0.0.1|' || CAST(conv_id AS VARCHAR) ELSE '' END AS iocs,
       CASE WHEN is_full THEN 'l1|l2|l3|l4|l5|l6|l7|l8|l9|l10' ELSE '' END AS lines, turn * 60 AS first_sec
FROM f""")
def finding_fields(spark, sf_dir):
    alerts = findings.alerts_from_responses(fx.responses(spark, sf_dir))
    return alerts.filter(F.col("title") != findings.ERROR_TITLE).select(
        "source_file", "chunk_index", "title", "description", "recommendation",
        F.array_join("iocs", "|").alias("iocs"), F.array_join("affected_lines", "|").alias("lines"),
        F.unix_seconds("timestamp_first").alias("first_sec"))


@query(_R + """
SELECT source_file, chunk_index, 'block_ip' AS action, 'block it' AS command, false AS reversible, '' AS undo_command
FROM f WHERE is_full""")
def finding_remediation(spark, sf_dir):
    alerts = findings.alerts_from_responses(fx.responses(spark, sf_dir))
    return alerts.filter("remediation IS NOT NULL").select("source_file", "chunk_index", "remediation.*")


@query(_R + "SELECT source_file, chunk_index FROM r WHERE kind = 1")
def responses_needing_repair(spark, sf_dir):
    return _read(spark, sf_dir).filter("needs_repair").select("source_file", "chunk_index")


@query(_R + """
SELECT source_file, chunk_index, CAST(CASE WHEN kind = 5 THEN 2 WHEN kind IN (0, 4) THEN 1
  WHEN kind = 1 AND conv_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_items,
  kind = 1 AND conv_id % 2 = 0 AS was_repaired FROM r""")
def repair_resolve(spark, sf_dir):
    """Only answers that needed it are replaced; where no second answer came the first one stands."""
    keys = ["source_file", "chunk_index"]
    resolved = findings.repair_resolve(fx.responses(spark, sf_dir), fx.repaired(spark, sf_dir), keys)
    return findings.read_responses(resolved).select(
        *keys, F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.exists("items", lambda i: findings.title(i) == "repaired").alias("hit"),
    ).select(*keys, "n_items", F.coalesce("hit", F.lit(False)).alias("was_repaired"))


@query("""
WITH l AS (SELECT source, doc_id, CASE WHEN doc_id % 5 <> 0 THEN '[chunk ' || doc_id || '] ' || text END AS line
           FROM documents),
c AS (SELECT source, doc_id, string_agg(line, chr(10) ORDER BY doc_id)
        OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM l)
SELECT source AS source_file, doc_id AS chunk_index,
       CASE WHEN length(t) > 1500 THEN '...' || chr(10) || right(t, 1500) ELSE t END AS context FROM c""")
def rolling_context(spark, sf_dir):
    """Documents as chunks; every fifth has neither findings nor a summary."""
    d = F.col("doc_id")
    line = F.concat(F.lit("[chunk "), d.cast("string"), F.lit("] "), F.col("text"))
    chunks = fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_file"), d.alias("chunk_index"), F.when(d % 5 != 0, line).alias("line"))
    return requests.rolling_context(chunks, ["source_file"]).select("source_file", "chunk_index", "context")


@query("""
SELECT doc_id, CAST(2 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n,
       'system' || CASE WHEN doc_id % 2 = 0 THEN ',system' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ',system' ELSE '' END || ',user' AS roles,
       md5('rules' || CASE WHEN doc_id % 2 = 0
             THEN '[Threat Intelligence Context — use to enrich analysis with technique IDs, CVE refs, and tactic names]'
                  || chr(10) || chr(10) || lang || chr(10) || chr(10) || '---' || chr(10) || chr(10) || source ELSE '' END
           || CASE WHEN doc_id % 3 = 0 THEN '[Context from previously analyzed batches]' || chr(10) || 'before' ELSE '' END
           || 'Analyze these log entries for threats:' || chr(10) || chr(10) || text) AS text_hash
FROM documents""")
def analysis_requests(spark, sf_dir):
    """Documents as chunk texts; intel and context present on some."""
    d = F.col("doc_id")
    snippets = F.when(d % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    built = requests.messages("rules", F.col("text"), snippets, F.when(d % 3 == 0, "before"))
    return fx.table(spark, sf_dir, "documents").withColumn("messages", built).select(
        "doc_id", F.size("messages").cast("bigint").alias("n"), F.array_join("messages.role", ",").alias("roles"),
        F.md5(F.array_join("messages.content", "")).alias("text_hash"))


@query("""SELECT 'src' AS source_file, doc_id AS chunk_index, md5('Analyze these log entries for threats:' || chr(10) || chr(10) || text) AS title,
  CASE WHEN length(text) % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM documents""")
def scored_findings(spark, sf_dir):
    """Whole documents as requests, scored by a pandas UDF; those of odd length answer wrongly at first and are repaired."""
    rows = fx.table(spark, sf_dir, "documents").select(
        F.lit("src").alias("source_file"), F.col("doc_id").alias("chunk_index"),
        F.lit("syslog").alias("log_format"), F.lit(None).cast("timestamp").alias("timestamp_first"),
        F.lit(None).cast("timestamp").alias("timestamp_last"), F.array(F.lit("line")).alias("first_lines"),
        requests.messages("rules", F.col("text")).alias("messages"))

    @F.pandas_udf("string")
    def model(messages: pd.Series) -> pd.Series:
        def answer(m):
            asked = next(x["content"] for x in m if x["role"] == "user")
            even = (len(asked) - len(asked.split("\n\n")[0]) - 2) % 2 == 0
            good = f'{{"alerts":[{{"title":"{hashlib.md5(asked.encode()).hexdigest()}","severity":"{"high" if even else "low"}"}}]}}'
            return good if even or m[-1]["content"] == "fix" else '{"alerts":["just text"]}'

        return messages.map(answer)

    return score_requests(rows, model, "fix").select("source_file", "chunk_index", "title", "severity")
