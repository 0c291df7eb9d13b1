"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import decontam, langid, linededup, mixing, simhash
from emberlog.llm.common import free_name, stored, table
from emberlog.llm.queries import fold
from emberlog.operators.joins import attach
from emberlog.session import configure

#: Documents whose language is less certain than this are rejected.
LEAST_CERTAIN = 0.5


def _shape(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The columns of ``of``; a count of characters follows the text."""
    if "n_chars" in of.columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(of.schema["n_chars"].dataType))
    return docs.select(*of.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and certain stay; the model learns from the two thirds that are not held out."""
    configure(spark)
    model = langid.train(docs, fold("doc_id", 3) != 1)
    lang, certain = free_name(docs, "predicted"), free_name(docs, "certain")
    found = langid.identify(docs, model, lang=lang, score=certain)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(certain) >= LEAST_CERTAIN)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are deleted; documents of which nothing is left go."""
    configure(spark)
    runs = free_name(docs, "deleted")
    deduped = linededup.dedup_lines(docs, runs=runs)
    kept = deduped.filter((F.size(runs) == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return _shape(kept, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (3-word shingles, 2 bits) one document stays.

    It is the one with the least id, null last, of several the one with the least hash of its text. Rows equal in id and text
    are one document, of which one row stays.
    """
    configure(spark)
    text, mark, rank = (free_name(docs, n) for n in ("version", "keep", "rank"))
    # groups are found under a number of the row's own, so that rows without an id, or with the same one, are told apart
    numbered = stored(docs.withColumns({mark: F.monotonically_increasing_id(), text: F.xxhash64("text")}), "numbered")
    groups = simhash.near_duplicates(numbered.select(F.col(mark).alias("row"), "text"), key="row")
    named = numbered.select(F.col(mark).alias("row"), F.col("doc_id").isNull().alias("none"), "doc_id", F.col(text).alias("version"))
    grouped = stored(groups.select("row", "component").join(named, "row"), "grouped")
    first = grouped.groupBy("component").agg(F.min(F.struct("none", "doc_id", "version", "row")).alias(rank))
    # the rows that go are fewer than those that stay
    gone = grouped.join(stored(first.select("component", F.col(f"{rank}.row").alias("_first")), "firsts"), "component").filter("row <> _first")
    gone = stored(gone.select(F.col("row").alias(mark)), "gone")
    return attach(numbered, gone, [mark], "left_anti", salts=8).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    configure(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: sources at weights 1, 2, 3, at most 3 epochs; a row for each time that a document is taken."""
    configure(spark)
    return mixing.take(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash", near_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline on ``documents``."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
