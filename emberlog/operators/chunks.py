"""Token-bounded chunks of ordered lines.

The rule is sequential: a chunk closes when the next line would lift it above the budget, an oversized line stands
alone. To run it over a file of any size, lines are cut into blocks. What a block needs to know of the lines before
it is one number, the tokens already in the open chunk (at most the budget, as more than that closes the chunk just
the same). So a block is a function from that number to the one it hands on, held as a table of ``budget`` entries;
tables of neighbouring blocks compose, groups of blocks compose again, and once each block knows its own entry value
all blocks place their chunk starts independently. No task sees more than one block of lines or one group of tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.scalars import token_estimate
from emberlog.operators.parse import registered_names
from emberlog.schema import CHUNK_TOKENS, LOG_FORMATS, SEVERITIES, UNKNOWN
from emberlog.session import broadcast_if_small, materialize

LINES_PER_BLOCK = 2**19
BLOCKS_PER_GROUP = 256


def _next_starts(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for every line the line that starts the next chunk if a chunk starts here (n: none here)."""
    prefix = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
    fits_until = np.searchsorted(prefix, prefix[:-1] + budget, side="right") - 1
    return prefix, np.maximum(fits_until, np.arange(1, len(tokens) + 1))


def _first_start(prefix: np.ndarray, carried: np.ndarray, budget: int) -> np.ndarray:
    """First line that does not fit after ``carried`` tokens (n: all fit)."""
    return np.searchsorted(prefix, budget - carried, side="right") - 1


def _block_table(tokens: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For every number of carried tokens 0..budget: tokens handed on, and chunks started in the block."""
    n = len(tokens)
    prefix, step = _next_starts(tokens, budget)
    last = np.arange(n)
    hops = np.ones(n, dtype=np.int64)
    inside = step < n
    while inside.any():  # pointer doubling: the last chunk start reached from each line
        target = step[inside]
        hops[inside] += hops[target]
        last[inside] = last[target]
        step[inside] = step[target]
        inside = step < n
    carried = np.arange(budget + 1)
    first = _first_start(prefix, carried, budget)
    starts_here = first < n
    entry = np.where(starts_here, first, 0)
    handed = np.where(starts_here, prefix[n] - prefix[last[entry]], carried + prefix[n])
    return np.minimum(handed, budget), np.where(starts_here, hops[entry], 0)


def _starts(tokens: np.ndarray, carried: int, budget: int) -> list[int]:
    n = len(tokens)
    prefix, step = _next_starts(tokens, budget)
    at = int(_first_start(prefix, np.asarray(carried), budget))
    out = []
    while at < n:
        out.append(at)
        at = int(step[at])
    return out


def chunk_starts(lines: DataFrame, budget: int = CHUNK_TOKENS, keys: tuple[str, ...] = ("source_file",),
                 order: str = "line_no", tokens: str = "tokens", block: int = LINES_PER_BLOCK,
                 group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """``keys, block, start, chunk_index`` for every chunk; ``start`` is its first line's ``order`` value.

    ``order`` must be unique per key. Only keys, order and token counts pass through Python.
    """
    keys = list(keys)
    narrow = lines.select(
        *keys,
        F.floor(F.col(order) / block).alias("_block"),
        F.col(order).cast("bigint").alias("_order"),
        F.col(tokens).cast("bigint").alias("_tokens"),
    )
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keys)])

    def keyed(key: tuple, rows: int, **columns) -> pa.Table:
        named = {k: pa.array([v.as_py()] * rows, type=v.type) for k, v in zip(keys, key)}
        return pa.table({**named, **columns})

    def sorted_columns(table: pa.Table, by: str, *names: str) -> list[np.ndarray]:
        at = np.argsort(table[by].to_numpy(), kind="stable")
        return [table[n].to_numpy()[at] for n in names]

    def function_row(key: tuple, label: str, handed: np.ndarray, started: np.ndarray) -> pa.Table:
        return keyed(key, 1, **{label: pa.array([key[len(keys)].as_py()], pa.int64())},
                     _handed=pa.array([handed], pa.list_(pa.int32())), _started=pa.array([started], pa.list_(pa.int64())))

    def functions(table: pa.Table, by: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tables of functions in order, one row of ``budget + 1`` entries per function."""
        at = np.argsort(table[by].to_numpy(), kind="stable")
        flat = [table[c].combine_chunks().flatten().to_numpy().reshape(-1, budget + 1)[at] for c in ("_handed", "_started")]
        return list(zip(*flat))

    def block_function(key: tuple, table: pa.Table) -> pa.Table:
        (counts,) = sorted_columns(table, "_order", "_tokens")
        return function_row(key, "_block", *_block_table(counts, budget))

    names = f"{key_ddl}, {{}} bigint, _handed array<int>, _started array<bigint>"
    tables = materialize(
        narrow.groupBy(*keys, "_block").applyInArrow(block_function, names.format("_block"))
        .withColumn("_group", F.floor(F.col("_block") / group))
    )

    def compose(key: tuple, table: pa.Table) -> pa.Table:
        state, started = np.arange(budget + 1), np.zeros(budget + 1, dtype=np.int64)
        for next_handed, next_started in functions(table, "_block"):
            started = started + next_started[state]
            state = next_handed[state]
        return function_row(key, "_group", state, started)

    def walk(by: str):
        def follow(key: tuple, table: pa.Table) -> pa.Table:
            # a file begins like a full chunk: its first line opens a new one
            entered = "_enter" in table.column_names
            state = table["_enter"][0].as_py() if entered else budget
            done = table["_before"][0].as_py() if entered else 0
            enter, before = [], []
            for handed, started in functions(table, by):
                enter.append(state)
                before.append(done)
                done += int(started[state])
                state = int(handed[state])
            (place,) = sorted_columns(table, by, by)
            return keyed(key, len(place), **{by: pa.array(place, pa.int64())},
                         _enter=pa.array(enter, pa.int64()), _before=pa.array(before, pa.int64()))

        return follow

    groups = (
        tables.groupBy(*keys, "_group").applyInArrow(compose, names.format("_group"))
        .groupBy(*keys).applyInArrow(walk("_group"), f"{key_ddl}, _group bigint, _enter bigint, _before bigint")
    )
    blocks = (
        tables.join(groups, [*keys, "_group"])
        .groupBy(*keys, "_group").applyInArrow(walk("_block"), f"{key_ddl}, _block bigint, _enter bigint, _before bigint")
    )

    def place(key: tuple, table: pa.Table) -> pa.Table:
        order_values, counts = sorted_columns(table, "_order", "_order", "_tokens")
        at = _starts(counts, table["_enter"][0].as_py(), budget)
        index = table["_before"][0].as_py() + np.arange(len(at))  # the first chunk of a file has index 0
        return keyed(key, len(at), block=pa.array([key[-1].as_py()] * len(at), pa.int64()),
                     start=pa.array(order_values[at], pa.int64()), chunk_index=pa.array(index, pa.int64()))

    return (
        narrow.join(blocks.hint("merge"), [*keys, "_block"])  # on the keys the next step groups by
        .groupBy(*keys, "_block").applyInArrow(place, f"{key_ddl}, block bigint, start bigint, chunk_index bigint")
    )


def assign_chunks(lines: DataFrame, budget: int = CHUNK_TOKENS, keys: tuple[str, ...] = ("source_file",),
                  order: str = "line_no", raw: str = "raw", block: int = LINES_PER_BLOCK,
                  group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """Add ``tokens``, ``chunk_index`` and ``chunk_block`` (the block in which the line's chunk starts) to every line.

    A line takes the last chunk start at or before it, by a window over the lines of one ``chunk_block``. Those before
    a block's first start belong to the chunk still open from an earlier block; a table of one row per block tells
    which. As chunks are never split over chunk blocks, ``chunk_table`` needs no second shuffle of the text.
    """
    keys = list(keys)
    lines = lines.withColumn("tokens", token_estimate(F.col(raw))).withColumn("_block", F.floor(F.col(order) / block))
    starts = materialize(chunk_starts(lines, budget, tuple(keys), order, "tokens", block, group))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = starts.groupBy(*keys, F.col("block").alias("_block")).agg(F.min("start").alias("_first"))
    blocks = lines.select(*keys, "_block").distinct().join(first, [*keys, "_block"], "left")
    blocks = materialize(blocks.withColumn(
        "_open", F.last(F.when(F.col("_first").isNotNull(), F.col("_block")), True).over(earlier)))

    home = F.when(F.col(order) >= F.col("_first"), F.col("_block")).otherwise(F.col("_open"))
    placed = (
        lines.join(broadcast_if_small(blocks), [*keys, "_block"])
        .withColumn("chunk_block", home).drop("_block", "_first", "_open")
    )
    marks = starts.select(
        *keys, F.col("block").alias("chunk_block"), F.col("start").alias(order), "chunk_index", F.lit(True).alias("_mark"))
    upto = (
        Window.partitionBy(*keys, "chunk_block").orderBy(F.col(order), F.col("_mark").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        placed.unionByName(marks, allowMissingColumns=True)
        .withColumn("chunk_index", F.max("chunk_index").over(upto))
        .filter(F.col("_mark").isNull())
        .drop("_mark")
    )


def chunk_table(chunked: DataFrame, keys: tuple[str, ...] = ("source_file",), order: str = "line_no") -> DataFrame:
    """One row per chunk: text, time range, format of the first line, line and token counts.

    A chunk holds at most ``budget`` lines, since every line counts at least one token, so its collected list is bounded.
    Lines fresh from ``assign_chunks`` are grouped where they are, without another shuffle.
    """
    line = F.struct(F.col(order), F.col("raw"))
    time = F.col("event_ts") if "event_ts" in chunked.columns else F.lit(None).cast("timestamp")
    fmt = F.col("format") if "format" in chunked.columns else F.lit(UNKNOWN)
    texts = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["raw"])
    home = ["chunk_block"] if "chunk_block" in chunked.columns else []
    return (
        chunked.groupBy(*keys, *home, "chunk_index")
        .agg(
            texts.alias("_lines"),
            F.min(time).alias("timestamp_first"),
            F.max(time).alias("timestamp_last"),
            F.min_by(fmt, F.col(order)).alias("log_format"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("tokens").alias("tokens"),
        )
        .withColumn("chunk_text", F.array_join("_lines", "\n"))
        .withColumn("first_lines", F.slice("_lines", 1, 10))
        .drop("_lines", *home)
    )


def session_table(chunked: DataFrame, alerts: DataFrame, order: str = "line_no") -> DataFrame:
    """One row per source: lines, chunks, first known format, alerts per severity and in total."""
    # The first known format is the least of line * 64 + code: a number, so lines are combined by hashing, not sorting.
    names_by_code = F.lit([*LOG_FORMATS, *registered_names()])
    code = F.array_position(names_by_code, F.col("format"))
    first = F.min(F.when(code > 0, F.col(order) * 64 + code))
    files = chunked.groupBy("source_file").agg(
        first.alias("_first"),
        F.count(F.lit(1)).alias("total_lines"),
        (F.max("chunk_index") + 1).alias("total_chunks"),
    ).withColumn("log_format", F.get(names_by_code, (F.pmod("_first", F.lit(64)) - 1).cast("int"))).drop("_first")
    counts = alerts.groupBy("source_file").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    )
    names = [s.lower() for s in SEVERITIES]
    joined = files.join(counts, "source_file", "left").na.fill(0, names)
    total = F.lit(0)
    for n in names:
        total = total + F.col(n)
    return joined.withColumn("total_alerts", total.cast("bigint"))


def summary_line(sessions: DataFrame) -> DataFrame:
    """Text summary per source; severities without alerts are left out."""
    parts = [
        F.when(F.col(s.lower()) > 0, F.concat(F.col(s.lower()).cast("string"), F.lit(f" {s.lower()}")))
        for s in SEVERITIES
    ]
    findings = F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("no alerts"))
    text = F.concat_ws(
        " | ",
        F.col("source_file"),
        F.coalesce(F.col("log_format"), F.lit("")),
        F.concat(F.col("total_lines").cast("string"), F.lit(" lines")),
        F.concat(F.col("total_chunks").cast("string"), F.lit(" chunks")),
        findings,
    )
    return sessions.withColumn("summary", text)
