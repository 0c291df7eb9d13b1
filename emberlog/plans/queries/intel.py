"""Threat-intelligence tables and retrieval."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.operators import intel, similarity
from emberlog.plans import fixtures as fx
from emberlog.plans.queries import query
from emberlog.session import scratch_path
from emberlog.sources import feeds

_ATTACK = """WITH t AS (
  SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'T' || (doc_id + 1000) END AS tid,
         CASE WHEN doc_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, source] END AS tactics
  FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 <> 0 AND doc_id % 19 <> 0 AND regexp_matches(text, '\\S')),
a AS (
  SELECT 'mitre-' || CASE WHEN tid <> '' THEN tid ELSE 'attack-pattern--' || doc_id END AS id,
         '[' || tid || '] Technique ' || doc_id || chr(10) || 'Tactics: ' || array_to_string(tactics, ', ') || chr(10) || chr(10) || left(body, 2000) AS text,
         'mitre-attack' AS source, CAST(NULL AS DOUBLE) AS cvss, 'Technique ' || doc_id AS name, doc_id, tid, tactics FROM t)
"""
_CVE = """, v AS (
  SELECT *, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND n_chars % 100 <> 0 THEN CAST(CAST(n_chars % 100 / 10 AS DECIMAL(3,1)) AS VARCHAR)
                 WHEN doc_id % 2 = 0 THEN '5.5' ELSE '' END AS score
  FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 10 <> 3 AND text <> ''),
n AS (
  SELECT 'cve-CVE-2024-' || doc_id AS id, '[CVE-2024-' || doc_id || '] CVSS: ' || score || chr(10) || left(text, 2000) AS text,
         'nvd' AS source, TRY_CAST(score AS DOUBLE) AS cvss, doc_id, score FROM v)
"""
_BOTH = _ATTACK + _CVE + ", i AS (SELECT id, text, source, cvss FROM a UNION ALL SELECT id, text, source, cvss FROM n) "


def _all(spark, sf_dir, per_source=0):
    return intel.build(
        [intel.attack_chunks(fx.attack_objects(spark, sf_dir)), intel.cve_chunks(fx.cve_items(spark, sf_dir))], per_source)


@query(_ATTACK + "SELECT doc_id, name FROM a")
def attack_filter(spark, sf_dir):
    return intel.attack_patterns(fx.attack_objects(spark, sf_dir)).select(
        F.replace("name", F.lit("Technique "), F.lit("")).cast("bigint").alias("doc_id"), "name")


@query(_ATTACK + "SELECT name, tid AS technique_id FROM a")
def attack_technique_id(spark, sf_dir):
    return intel.attack_patterns(fx.attack_objects(spark, sf_dir)).select(
        "name", intel.technique_id(F.col("external_references")).alias("technique_id"))


@query(_ATTACK + "SELECT name, array_to_string(tactics, ',') AS tactics FROM a")
def attack_tactics(spark, sf_dir):
    return intel.attack_patterns(fx.attack_objects(spark, sf_dir)).select(
        "name", F.array_join(intel.tactics(F.col("kill_chain_phases")), ",").alias("tactics"))


@query(_ATTACK + "SELECT id, text, tid AS technique_id, name, array_to_string(tactics, ',') AS tactics FROM a")
def attack_chunks(spark, sf_dir):
    m = F.col("metadata")
    return intel.attack_chunks(fx.attack_objects(spark, sf_dir)).select(
        "id", "text", m["technique_id"].alias("technique_id"), m["name"].alias("name"), m["tactics"].alias("tactics"))


@query(_ATTACK + _CVE + "SELECT 'CVE-2024-' || doc_id AS cve_id FROM n")
def cve_filter(spark, sf_dir):
    return intel.published_cves(fx.cve_items(spark, sf_dir)).select(F.col("cve.CVE_data_meta.ID").alias("cve_id"))


@query(_ATTACK + _CVE + "SELECT 'CVE-2024-' || doc_id AS cve_id, score FROM n")
def cve_score(spark, sf_dir):
    return intel.published_cves(fx.cve_items(spark, sf_dir)).select(
        F.col("cve.CVE_data_meta.ID").alias("cve_id"), intel.cvss_score(F.col("impact")).alias("score"))


@query(_ATTACK + _CVE + "SELECT id, text, cvss, score AS cvss_score FROM n")
def cve_chunks(spark, sf_dir):
    return intel.cve_chunks(fx.cve_items(spark, sf_dir)).select(
        "id", "text", "cvss", F.col("metadata")["cvss_score"].alias("cvss_score"))


@query(_BOTH + "SELECT * FROM i")
def intel_build(spark, sf_dir):
    return _all(spark, sf_dir).drop("metadata")


@query(_BOTH + "SELECT source, count(*) AS n FROM i GROUP BY source")
def intel_counts_by_source(spark, sf_dir):
    return intel.counts_by_source(_all(spark, sf_dir))


@query(_BOTH + "SELECT id, source FROM i QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= 50")
def intel_limit_per_source(spark, sf_dir):
    return _all(spark, sf_dir, 50).select("id", "source")


@query(_BOTH + "SELECT id, CASE WHEN source = 'nvd' THEN 'updated' ELSE text END AS text FROM i")
def intel_upsert(spark, sf_dir):
    """The vulnerability rows arrive again with new text."""
    current = _all(spark, sf_dir)
    again = current.filter("source = 'nvd'").withColumn("text", F.lit("updated"))
    return intel.upsert(current, again).select("id", "text")


def _written(objects, member: str):
    """Objects written as feed files, one JSON document with one array per task, an object a line."""
    path = scratch_path(objects.sparkSession, "feed")

    def document(batches):
        before = f'{{"{member}":['
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield before + text
                before = ","
        yield ("" if before == "," else before) + "]}"

    def lines(batches):
        texts = document(batches)
        while some := list(islice(texts, 1000)):
            yield pa.RecordBatch.from_pydict({"text": some})

    objects.select(F.to_json(F.struct(*objects.columns)).alias("text")).mapInArrow(lines, "text string").write.text(path)
    return path


@query(_ATTACK + "SELECT id, text, tid AS technique_id FROM a")
def attack_bundle_scan(spark, sf_dir):
    path = _written(fx.attack_objects(spark, sf_dir), "objects")
    return intel.attack_chunks(feeds.read_attack_bundle(spark, path, split_bytes=1 << 14)).select(
        "id", "text", F.col("metadata")["technique_id"].alias("technique_id"))


@query(_ATTACK + _CVE + "SELECT id, text, cvss FROM n")
def cve_feed_scan(spark, sf_dir):
    path = _written(fx.cve_items(spark, sf_dir), "CVE_Items")
    return intel.cve_chunks(feeds.read_cve_feed(spark, path, split_bytes=1 << 14)).select("id", "text", "cvss")


_TOP = """WITH p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS intel_id,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, intel_id) AS rank FROM p QUALIFY rank <= 3)
"""


@query(_TOP + "SELECT query_id, intel_id, rank, round(score, 6) AS score FROM t")
def cosine_topk(spark, sf_dir):
    """Every vector against all others."""
    v = fx.vectors(spark, sf_dir)
    return similarity.cosine_topk(v, v, exclude_self=True).withColumn("score", F.round("score", 6))


@query(_TOP + "SELECT query_id, intel_id, rank, round(score, 6) AS score FROM t")
def cosine_topk_cells(spark, sf_dir):
    """The same by cells, the way taken when the corpus is too large to broadcast."""
    v = fx.vectors(spark, sf_dir)
    return similarity.cosine_topk(v, v, exclude_self=True, corpus_bytes=0).withColumn("score", F.round("score", 6))


@query(_TOP + """
SELECT query_id AS id, string_agg('intel ' || intel_id || ' label ' || label, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM t JOIN embeddings ON vec_id = intel_id GROUP BY query_id""")
def chunk_intel_context(spark, sf_dir):
    from emberlog.operators.requests import SNIPPET_RULE

    v = fx.vectors(spark, sf_dir)
    near = similarity.cosine_topk(v, v, exclude_self=True)
    joined = similarity.snippets(v, near, fx.vector_texts(spark, sf_dir))
    return joined.select("id", F.array_join("snippets", SNIPPET_RULE).alias("context"))
