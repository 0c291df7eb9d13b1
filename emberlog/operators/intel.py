"""Threat-intelligence tables from attack-pattern objects and vulnerability items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import strip
from emberlog.schema import INTEL, conform

# --- fixed values -----------------------------------------------------------------
KILL_CHAIN = "mitre-attack"
MAX_TEXT_CHARS = 2000
WITHDRAWN = ["** RESERVED", "** REJECT"]
ATTACK_OBJECT = (
    "struct<type:string, id:string, name:string, description:string, revoked:boolean, x_mitre_deprecated:boolean, "
    "external_references:array<struct<source_name:string, external_id:string>>, "
    "kill_chain_phases:array<struct<kill_chain_name:string, phase_name:string>>>"
)
CVE_ITEM = (
    "struct<cve:struct<CVE_data_meta:struct<ID:string>, "
    "description:struct<description_data:array<struct<lang:string, value:string>>>>, "
    "impact:struct<baseMetricV3:struct<cvssV3:struct<baseScore:string>>, "
    "baseMetricV2:struct<cvssV2:struct<baseScore:string>>>>"
)
# ----------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def attack_patterns(objects: DataFrame) -> DataFrame:
    """Current techniques only: not revoked or deprecated, with a description."""
    return objects.filter(
        (F.col("type") == "attack-pattern")
        & ~F.coalesce("revoked", F.lit(False))
        & ~F.coalesce("x_mitre_deprecated", F.lit(False))
        & (strip(_text(F.col("description"))) != "")
    )


def technique_id(references: Column) -> Column:
    own = F.filter(references, lambda r: r["source_name"] == KILL_CHAIN)
    return _text(F.get(own, F.lit(0))["external_id"])


def tactics(phases: Column) -> Column:
    own = F.filter(phases, lambda p: p["kill_chain_name"] == KILL_CHAIN)
    return F.coalesce(F.transform(own, lambda p: p["phase_name"]), F.array().cast("array<string>"))


def attack_chunks(objects: DataFrame) -> DataFrame:
    tid, names = technique_id(F.col("external_references")), tactics(F.col("kill_chain_phases"))
    rows = attack_patterns(objects).withColumns({"_tid": tid, "_tactics": names})
    return rows.select(
        F.concat(F.lit("mitre-"), F.when(F.col("_tid") != "", F.col("_tid")).otherwise(F.col("id"))).alias("id"),
        F.concat(
            F.lit("["), "_tid", F.lit("] "), _text(F.col("name")), F.lit("\nTactics: "),
            F.array_join("_tactics", ", "), F.lit("\n\n"),
            F.left(strip(F.col("description")), F.lit(MAX_TEXT_CHARS)),
        ).alias("text"),
        F.lit("mitre-attack").alias("source"),
        F.lit(None).cast("double").alias("cvss"),
        F.create_map(
            F.lit("source"), F.lit("mitre-attack"),
            F.lit("technique_id"), F.col("_tid"),
            F.lit("name"), _text(F.col("name")),
            F.lit("tactics"), F.array_join("_tactics", ","),
        ).alias("metadata"),
    )


def english(descriptions: Column) -> Column:
    return _text(F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"])


def published_cves(items: DataFrame) -> DataFrame:
    """Adds ``description``; entries without English text and withdrawn entries are left out."""
    text = F.col("description")
    return items.withColumn("description", english(F.col("cve.description.description_data"))).filter(
        (text != "") & ~text.startswith(WITHDRAWN[0]) & ~text.startswith(WITHDRAWN[1]))


def cvss_score(impact: Column) -> Column:
    """Version 3 base score, else version 2, as written; a score of 0 counts as missing, none is empty."""

    def given(score: Column) -> Column:
        return F.when(score.try_cast("double") != 0, score)

    return F.coalesce(
        given(impact["baseMetricV3"]["cvssV3"]["baseScore"]),
        given(impact["baseMetricV2"]["cvssV2"]["baseScore"]),
        F.lit(""),
    )


def cve_chunks(items: DataFrame) -> DataFrame:
    rows = published_cves(items).withColumns({
        "_id": _text(F.col("cve.CVE_data_meta.ID")), "_score": cvss_score(F.col("impact"))})
    return rows.select(
        F.concat(F.lit("cve-"), "_id").alias("id"),
        F.concat(F.lit("["), "_id", F.lit("] CVSS: "), "_score", F.lit("\n"),
                 F.left("description", F.lit(MAX_TEXT_CHARS))).alias("text"),
        F.lit("nvd").alias("source"),
        F.col("_score").try_cast("double").alias("cvss"),
        F.create_map(
            F.lit("source"), F.lit("nvd"),
            F.lit("cve_id"), F.col("_id"),
            F.lit("cvss_score"), F.col("_score"),
        ).alias("metadata"),
    )


def first_n(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows per source, smallest ids first; 0 keeps all."""
    if n <= 0:
        return rows
    order = Window.partitionBy("source").orderBy("id")
    return rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def build(sources: list[DataFrame], per_source: int = 0) -> DataFrame:
    """One table of all sources, one row per id: that of the last source that has it, by text if one has several."""
    numbered = [conform(rows, INTEL).withColumn("_from", F.lit(i)) for i, rows in enumerate(sources)]
    rows = numbered[0]
    for more in numbered[1:]:
        rows = rows.unionByName(more)
    newest = Window.partitionBy("id").orderBy(F.col("_from").desc(), F.col("text").desc())
    return first_n(rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_from"), per_source)


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace rows of the same id; the last of several new rows with one id is not defined."""
    both = current.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    newest = Window.partitionBy("id").orderBy(F.col("_batch").desc(), F.col("text").desc())
    return both.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_batch")


def counts_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def available(rows: DataFrame) -> bool:
    return not rows.isEmpty()
