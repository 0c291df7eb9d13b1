"""From log files to stored alerts: the batch job, and the scoring job for an external model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import alerts as reports
from emberlog.operators import chunks as chunking
from emberlog.operators import detectors, findings, requests, similarity
from emberlog.operators.parse import parse_corpus
from emberlog.schema import INTEL_TOP_N
from emberlog.session import materialize
from emberlog.sources.alert_tables import BATCH, folder, next_batch, read_alerts, write_batch, write_ioc_delta
from emberlog.sources.lines import number_lines, scan_lines


def analyze_lines(lines: DataFrame, out: str, batch_id: int | None = None, fmt: str | None = None,
                  detect: Callable[[DataFrame], DataFrame] = detectors.detect_all,
                  generated_at: Column | None = None, baseline: DataFrame | None = None, feed: str = BATCH,
                  **parse_options) -> int:
    """Parse lines, detect threats, and store parsed lines, alerts and indicator counts under ``out``; returns the batch id.

    The parsed table is written once, with what detectors read out of texts already in columns (``detectors.tag``); every
    detector reads back only the few columns it needs. ``baseline`` (``src, dst``) adds the search for new internal
    connections. Without ``batch_id`` the batch gets one of its own; writing the same id of the same feed again replaces what
    that batch wrote before.
    """
    spark = lines.sparkSession
    batch_id = next_batch(spark, out, feed) if batch_id is None else batch_id
    parsed_path = folder(out, "parsed", batch_id, feed)
    parsed = detectors.tag(parse_corpus(number_lines(lines), fmt, dense=True, **parse_options))
    parsed.write.mode("overwrite").parquet(parsed_path)
    parsed = spark.read.parquet(parsed_path)
    found = detect(parsed)
    if baseline is not None:
        found = found.unionByName(detectors.lateral_movement(detectors.connection_pairs(parsed), baseline))
    found = materialize(found)
    categories = [r["category"] for r in found.select("category").distinct().collect()]  # a handful of names
    evidence = detectors.evidence_lines(parsed, categories)
    alerts = detectors.to_alerts(detectors.with_evidence(found, evidence), generated_at)
    write_batch(alerts, out, batch_id, feed)
    write_ioc_delta(spark, out, batch_id, feed)
    return batch_id


def analyze(spark: SparkSession, paths: str | list[str], out: str, min_severity: str = "LOW", batch_id: int | None = None,
            fmt: str | None = None, **options) -> DataFrame:
    """Analyse log files; returns the stored alerts of at least ``min_severity``, newest first. Earlier runs' alerts stay."""
    analyze_lines(scan_lines(spark, paths), out, batch_id, fmt, **options)
    return reports.by_severity(read_alerts(spark, out), min_severity)


def chunk_requests(parsed: DataFrame, system_text: str, intel: DataFrame | None = None,
                   vectors: DataFrame | None = None, prior: DataFrame | None = None,
                   top_n: int = INTEL_TOP_N, budget: int = chunking.CHUNK_TOKENS) -> DataFrame:
    """One scoring request per chunk of a parsed table.

    ``intel``: id, text, embedding. ``vectors``: source_file, chunk_index, embedding of the chunk texts (made by the
    user's embedding step; left out, no snippets are added). ``prior``: source_file, chunk_index, line, what an
    earlier pass found, from which each chunk gets its rolling context.
    """
    keys = ["source_file", "chunk_index"]
    table = chunking.chunk_table(chunking.assign_chunks(parsed, budget))
    snippets = context = None
    if intel is not None and vectors is not None:
        ids = F.concat_ws("\u0001", "source_file", F.col("chunk_index").cast("string"))
        table = table.withColumn("id", ids)
        near = similarity.cosine_topk(vectors.withColumn("id", ids), intel, top_n)
        table = similarity.snippets(table, near, intel).drop("id")
        snippets = F.col("snippets")
    if prior is not None:
        table = requests.rolling_context(table.join(prior.select(*keys, "line"), keys, "left"), ["source_file"])
        context = F.col("context")
    return table.withColumn("messages", requests.messages(system_text, F.col("chunk_text"), snippets, context))


def answered(rows: DataFrame, model: Callable, repair_text: str) -> DataFrame:
    """``rows`` with the ``response`` that counts. ``model`` is a pandas UDF from the message array to the answer text.

    Answers are written once, so the model is asked once per chunk; answers holding texts in place of objects are asked
    for again, and the second answer counts if there is one.
    """
    keys = ["source_file", "chunk_index"]
    first = materialize(requests.score(rows, model))
    faulty = findings.read_responses(first).filter("needs_repair").select(
        *keys, requests.repair_messages(F.col("messages"), F.col("response"), repair_text).alias("messages"))
    second = materialize(requests.score(faulty, model, "repaired_response"))
    return findings.repair_resolve(first, second, keys)


def score_requests(rows: DataFrame, model: Callable, repair_text: str, generated_at: Column | None = None) -> DataFrame:
    """Alerts from a model's answers to ``chunk_requests`` rows."""
    return findings.alerts_from_responses(answered(rows, model, repair_text), generated_at)
