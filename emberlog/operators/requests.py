"""Scoring requests: the message list of each chunk, with intel and what earlier chunks found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators import findings
from emberlog.operators.ordered import ROWS_PER_BLOCK, dense_position, last_before
from emberlog.schema import MAX_CONTEXT_CHARS

# --- fixed values -----------------------------------------------------------------
INTEL_HEADING = (
    "[Threat Intelligence Context — use to enrich analysis with technique IDs, CVE refs, and tactic names]\n\n"
)
SNIPPET_RULE = "\n\n---\n\n"
CONTEXT_HEADING = "[Context from previously analyzed batches]\n"
USER_HEADING = "Analyze these log entries for threats:\n\n"
CUT_MARK = "...\n"
# ----------------------------------------------------------------------------------

MESSAGES = "array<struct<role:string,content:string>>"


def context_line(chunk_index: Column, items: Column, summary: Column) -> Column:
    """``[chunk i] SEV: title; ...``, the summary when nothing was found, null when there is neither."""
    found = F.array_join(
        F.transform(items, lambda i: F.concat(findings.severity(i), F.lit(": "), findings.title(i))), "; ")
    body = F.when(F.size(items) > 0, found).when(summary != "", summary)
    return F.concat(F.lit("[chunk "), chunk_index.cast("string"), F.lit("] "), body)


def rolling_context(chunks: DataFrame, keys: list[str], order: str = "chunk_index", line: str = "line",
                    max_chars: int = MAX_CONTEXT_CHARS, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``context``: the lines of earlier chunks, newest last, cut to the last ``max_chars`` characters.

    Only a bounded tail can matter: a line takes at least 11 characters (``[chunk 0] x``) and a line feed, so
    ``max_chars // 12 + 2`` lines always exceed the cut. Chunks with a line are numbered densely and cut into
    blocks; each block also gets that many lines of the one before it. Chunks without a line take over the context
    that stood before them. Of a line longer than the cut only its end travels: it is cut within that line whatever follows.
    """
    tail = max_chars // 12 + 2
    block = max(block, tail)
    ends = F.right(line, F.lit(max_chars + 1)).alias(line)
    lined = dense_position(chunks.filter(F.col(line).isNotNull()).select(*keys, order, ends), keys, order, "_n", block)
    own = F.floor(F.col("_n") / block)
    frame = Window.partitionBy(*keys, "_part").orderBy("_n").rowsBetween(-(tail - 1), 0)
    text = F.array_join(F.collect_list(line).over(frame), "\n")
    after = (
        lined.withColumn("_part", F.explode(F.sequence(own, F.floor((F.col("_n") + tail) / block))))
        .withColumn("_text", text)
        .filter(F.col("_part") == own)
        .select(*keys, order, F.when(F.length("_text") <= max_chars, F.col("_text")).otherwise(
            F.concat(F.lit(CUT_MARK), F.right("_text", F.lit(max_chars)))).alias("_after"))
    )
    return last_before(chunks.join(after, [*keys, order], "left"), keys, order, "_after", "context", block).drop("_after")


def messages(system_text: str, chunk_text: Column, snippets: Column | None = None,
             context: Column | None = None) -> Column:
    """Ordered messages; parts without content are left out."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))

    nothing = F.lit(None).cast("string")
    intel = nothing if snippets is None else F.when(
        F.size(snippets) > 0, F.concat(F.lit(INTEL_HEADING), F.array_join(snippets, SNIPPET_RULE)))
    earlier = nothing if context is None else F.when(
        context != "", F.concat(F.lit(CONTEXT_HEADING), context))
    parts = F.array(
        message("system", F.lit(system_text)),
        message("system", intel),
        message("system", earlier),
        message("user", F.concat(F.lit(USER_HEADING), chunk_text)),
    )
    return F.filter(parts, lambda m: m["content"].isNotNull())


def repair_messages(request: Column, bad_response: Column, repair_text: str) -> Column:
    """The request again, followed by the answer it got and a demand to correct it."""
    more = F.array(
        F.struct(F.lit("assistant").alias("role"), bad_response.alias("content")),
        F.struct(F.lit("user").alias("role"), F.lit(repair_text).alias("content")),
    )
    return F.concat(request, more)


def score(requests: DataFrame, fn: Callable, output: str = "response") -> DataFrame:
    """Hook for an external model: ``fn`` is a pandas UDF from the message array to the response text."""
    return requests.withColumn(output, fn(F.col("messages")))
