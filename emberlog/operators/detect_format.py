"""Format detection: every format scores a file's first lines, the best score wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.formats import clf, jsonl, syslog, wincsv
from emberlog.schema import UNKNOWN
from emberlog.sources.lines import SAMPLE_LINES, sample_lines

# --- fixed values -----------------------------------------------------------------
MIN_SCORE = 0.3
CSV_NAME_BONUS = 0.2
# ----------------------------------------------------------------------------------

_registered: dict[str, Callable[[Column], Column]] = {}


def register_score(name: str, score: Callable[[Column], Column]) -> None:
    _registered[name] = score


def format_scores(sample: DataFrame, use_names: bool = True, **more: Column) -> DataFrame:
    """``source_file`` and one score column per format, from ``sample_lines`` rows (at most 20 per file).

    ``more``: further aggregates of the same rows, to be named in ``best_format``.
    """
    raw = F.col("raw")
    header = F.max(F.when(F.col("sample_no") == 1, wincsv.header_score(raw)))
    if use_names:
        named_csv = F.lower("source_file").endswith(".csv")
        header = F.when(named_csv, F.least(F.lit(1.0), header + CSV_NAME_BONUS)).otherwise(header)
    return sample.groupBy("source_file").agg(
        F.avg(syslog.score(raw)).alias("syslog"),
        F.avg(clf.score(raw)).alias("clf"),
        F.avg(jsonl.score(raw)).alias("json"),
        header.alias("windows_csv"),
        *[F.avg(score(raw).cast("int")).alias(name) for name, score in _registered.items()],
        *[column.alias(name) for name, column in more.items()],
    )


def best_format(scores: DataFrame, *more: str) -> DataFrame:
    """Highest score of at least 0.3, the earlier format on ties, ``unknown`` otherwise."""
    names = [c for c in scores.columns if c not in ("source_file", *more)]
    ranked = F.array(
        *[F.struct(F.col(n).alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
          for i, n in enumerate(names)]
    )
    return scores.withColumn("_best", F.array_max(ranked)).select(
        "source_file",
        F.when(F.col("_best.score") >= MIN_SCORE, F.col("_best.name")).otherwise(UNKNOWN).alias("format"),
        F.col("_best.score").alias("score"),
        *more,
    )


def detect_formats(lines: DataFrame, sample_size: int = SAMPLE_LINES, use_names: bool = True) -> DataFrame:
    """``source_file, format, score`` for a whole corpus at once."""
    return best_format(format_scores(sample_lines(lines, sample_size), use_names))
