"""Log lines as rows: file scans, in-memory lines, numbering and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.session import broadcast_if_small, fix_splits, materialize

SAMPLE_LINES = 20


def scan_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """``source_file, block_start, block_length, row_id, raw`` for every line that is not blank.

    Lines of one file are ordered by ``(block_start, row_id)``: a block is one input split, and row ids
    grow without gaps inside it because they are given after blank lines have been dropped.
    No shuffle; bytes that are not UTF-8 become replacement characters.
    """
    lines = spark.read.options(**options).text(paths)
    return (
        lines.select(
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.col("_metadata.file_block_length").alias("block_length"),
            F.make_valid_utf8("value").alias("raw"),
        )
        .filter(F.col("raw").rlike(r"\S"))
        .select("source_file", "block_start", "block_length", F.monotonically_increasing_id().alias("row_id"), "raw")
    )


def lines_from(df: DataFrame, raw: str, source: str | None = None, order: str | None = None) -> DataFrame:
    """Any table of lines in the layout of ``number_lines``: ``source_file, line_no, raw``."""
    out = df.select(
        (F.col(source).cast("string") if source else F.lit("")).alias("source_file"),
        (F.col(order) if order else F.monotonically_increasing_id()).cast("bigint").alias("line_no"),
        F.rtrim(F.make_valid_utf8(F.col(raw)), F.lit("\n")).alias("raw"),
    )
    return out.filter(F.col("raw").rlike(r"\S"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Dense ``line_no`` from 1 per file for a ``scan_lines`` table.

    A first narrow pass counts lines per input split. The running sum of those counts (one row per split, never
    per line) gives each split its offset, so no task ever sorts or holds a whole file. The offsets are broadcast
    when counted small; otherwise the join is on the split, which bounds every group by the split size.

    Both passes have to cut the files alike, so the number of splits is fixed first. A line whose split was not counted
    with the same start and length fails the job: none is ever left out.
    """
    fix_splits(lines.sparkSession)
    split = ["source_file", "block_start", "block_length"]
    splits = materialize(
        lines.groupBy(*split).agg(
            F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("_n")
        )
    )
    earlier = Window.partitionBy("source_file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        *split,
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    lost = F.raise_error(F.concat(F.lit("the file was cut differently when its lines were counted: "), "source_file"))
    return (
        lines.join(broadcast_if_small(offsets), split, "left")
        .select("source_file", (F.col("row_id") + F.coalesce("_shift", lost.cast("bigint"))).alias("line_no"), "raw")
    )


def sample_lines(lines: DataFrame, n: int = SAMPLE_LINES, dense: bool = False) -> DataFrame:
    """First ``n`` lines of every file: ``source_file, sample_no, raw`` (stripped), ``line`` (as it is), ``at`` (its place).

    The rank filter runs before the shuffle as well (window group limit), so at most ``n`` lines per file and
    task are exchanged. With ``dense`` line numbers, as given by ``number_lines``, a filter does and nothing is sorted.
    """
    order = ["block_start", "row_id"] if "row_id" in lines.columns else ["line_no"]
    first = Window.partitionBy("source_file").orderBy(*order)
    if dense:
        ranked = lines.withColumn("sample_no", F.col("line_no"))
    else:
        ranked = lines.withColumn("sample_no", F.row_number().over(first))
    return (
        ranked.filter(F.col("sample_no") <= n)
        .select("source_file", "sample_no", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("raw"),
                F.col("raw").alias("line"), F.struct(*order).alias("at"))
    )
