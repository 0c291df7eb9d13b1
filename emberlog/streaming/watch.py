"""Watch a folder of log files: every micro-batch of new files is parsed, searched and stored.

The file source reads whole new files, as rotated segments are; files that grow are followed by ``tail.follow_lines``. Every
batch writes to folders named by its id; a batch run again after a failure replaces its own output, so results are counted once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators import chunks as chunking
from emberlog.operators import findings, requests
from emberlog.operators.alerts import at_least
from emberlog.plans.analyze import answered
from emberlog.schema import MAX_CONTEXT_CHARS
from emberlog.session import materialize
from emberlog.sources.alert_tables import MODEL, WATCH, read_alerts, write_batch, write_ioc_delta
from emberlog.streaming.carry import SEARCHES, Search, search_lines
from emberlog.streaming.tail import follow_lines

# --- fixed values -----------------------------------------------------------------
POLL = "5 seconds"
MIN_SEVERITY = "MEDIUM"
# ----------------------------------------------------------------------------------


_STATE = "run_index bigint, line string, batch_id bigint"


def tail_lines(spark: SparkSession, folder: str, since: str | None = None,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming lines of new files: ``source_file, block_start, block_length, raw``; ``since`` leaves out files last changed earlier."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(folder)
    if since:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
    return lines.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_block_length").alias("block_length"),
        F.make_valid_utf8("value").alias("raw"),
    ).filter(F.col("raw").rlike(r"\S"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, since: str | None = None,
          fmt: str | None = None, on_alerts: Callable[[DataFrame, int], None] | None = None,
          min_severity: str = MIN_SEVERITY, available_now: bool = False, poll: str = POLL,
          max_files_per_trigger: int | None = None, searches: Sequence[Search] = SEARCHES, follow: bool = False,
          **options) -> StreamingQuery:
    """Start watching. ``on_alerts(alerts, batch_id)`` gets each batch's alerts of at least ``min_severity``.

    Each batch goes through ``searches`` (``carry``), which keep what they need of the batches before: a finding that spans any
    number of batches is one finding, as in the whole log. The feed is named after the checkpoint's own id: a watch with a new
    checkpoint never touches an old one's folders. With ``follow`` files may grow: each batch is what was appended since the
    one before (``tail.follow_lines``).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        lines = batch.select(
            "source_file", "block_start", "block_length", F.monotonically_increasing_id().alias("row_id"), "raw")
        feed = _feed(batch.sparkSession, checkpoint)
        search_lines(lines, out, batch_id, fmt, feed, searches, **options)
        if on_alerts:
            stored = read_alerts(batch.sparkSession, out, batch_id, feed)
            on_alerts(at_least(stored, min_severity), batch_id)

    lines = follow_lines(spark, folder) if follow else tail_lines(spark, folder, since, max_files_per_trigger)
    writer = lines.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": poll}
    return writer.trigger(**trigger).start()


def _feed(spark: SparkSession, checkpoint: str) -> str:
    """A name for one watch: the id that its checkpoint was given."""
    return WATCH + "-" + json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"][:8]


def continue_numbering(chunks: DataFrame, spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """Add ``run_index``, a chunk number that goes on from the batches before: files in name order, then their chunks.

    The offsets come from one row per file of the batch.
    """
    files = chunks.groupBy("source_file").agg((F.max("chunk_index") + 1).alias("_n"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("source_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = _next_index(spark, state, batch_id)
    return chunks.join(offsets, "source_file").withColumn(
        "run_index", F.col("chunk_index") + F.col("_before") + first).drop("_before")


def store_context(lines: DataFrame, state: str, batch_id: int) -> None:
    """Keep ``run_index, line`` of a batch's chunks for later batches."""
    lines.select("run_index", "line").write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")


def _earlier(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    try:
        rows = spark.read.schema(_STATE).parquet(state)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _STATE)
    return rows.filter(F.col("batch_id") < batch_id)


def _next_index(spark: SparkSession, state: str, batch_id: int) -> int:
    return _earlier(spark, state, batch_id).agg(F.coalesce(F.max("run_index") + 1, F.lit(0))).first()[0]


def earlier_context(spark: SparkSession, state: str, batch_id: int, max_chars: int = MAX_CONTEXT_CHARS) -> str:
    """Context text from all earlier batches; only the last lines that can matter are read into it."""
    tail = max_chars // 12 + 2
    last = _earlier(spark, state, batch_id).filter("line IS NOT NULL").orderBy(F.col("run_index").desc()).limit(tail)
    text = "\n".join(r["line"] for r in sorted(last.collect(), key=lambda r: r["run_index"]))
    return text if len(text) <= max_chars else requests.CUT_MARK + text[-max_chars:]


def score_batch(parsed: DataFrame, out: str, batch_id: int, model: Callable, system_text: str, repair_text: str) -> None:
    """Have a model judge one batch of parsed lines; its alerts are stored under ``out``.

    Chunk numbers go on from earlier batches, and each request carries what those found. Chunks of one batch are scored
    side by side, so they do not see each other's findings.
    """
    spark, state = parsed.sparkSession, f"{out}/context"
    table = continue_numbering(chunking.chunk_table(chunking.assign_chunks(parsed)), spark, state, batch_id)
    context = F.lit(earlier_context(spark, state, batch_id))
    rows = table.withColumn("chunk_index", F.col("run_index")).withColumn(
        "messages", requests.messages(system_text, F.col("chunk_text"), None, context))
    replies = materialize(answered(rows, model, repair_text))
    write_batch(findings.alerts_from_responses(replies), out, batch_id, MODEL)
    write_ioc_delta(spark, out, batch_id, MODEL)
    read = findings.read_responses(replies)
    no_items = F.array().cast("array<variant>")
    line = requests.context_line(F.col("run_index"), F.coalesce("items", no_items), F.col("chunk_summary"))
    store_context(read.withColumn("line", line), state, batch_id)
