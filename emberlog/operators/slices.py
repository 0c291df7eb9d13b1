"""Ordered per-key work over time, cut into slices so that no key is ever one task's load.

Rows are first combined per (key, second); the combine starts before the shuffle, so any number of log lines in one
second becomes one row. Time is then cut into slices, a slice sees the tail of the one before it where a frame
reaches back, and windows run per (key, slice): at most one row per second of the slice and its tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.ordered import ROWS_PER_BLOCK, dense_position

DAY = 86_400


def per_second(df: DataFrame, keys: list[str], second: Column, **aggs: Column) -> DataFrame:
    """One row per key and second: ``keys, sec, aggs``."""
    return df.withColumn("sec", second).groupBy(*keys, "sec").agg(*[a.alias(n) for n, a in aggs.items()])


def _slice_of(second: Column, width: int) -> Column:
    return F.floor(second / width)


def trailing(df: DataFrame, keys: list[str], seconds: int, until: int = 0, width: int = DAY,
             **aggs: Column) -> DataFrame:
    """Add window aggregates over ``[sec - seconds, sec - until]`` per key to a ``per_second`` table."""
    width = max(width, seconds)
    own, last = _slice_of(F.col("sec"), width), _slice_of(F.col("sec") + seconds, width)
    frame = Window.partitionBy(*keys, "_slice").orderBy("sec").rangeBetween(-seconds, -until)
    return (
        df.withColumn("_slice", F.explode(F.sequence(own, last)))
        .withColumns({n: a.over(frame) for n, a in aggs.items()})
        .filter(F.col("_slice") == _slice_of(F.col("sec"), width))
        .drop("_slice")
    )


def islands(df: DataFrame, keys: list[str], gap: int, width: int = DAY, **sums: Column) -> DataFrame:
    """Runs of seconds less than ``gap`` apart: ``keys, first_sec, last_sec`` and the aggregates in ``sums``.

    Runs are built per slice, then runs that continue across slices are joined by one window over runs.
    ``sums`` maps names to aggregates of columns of ``df`` that can be combined again: ``F.sum``, ``F.min``, ``F.max``
    given as (function, column) pairs.
    """
    inside = Window.partitionBy(*keys, "_slice").orderBy("sec")
    step = F.when(F.col("sec") - F.lag("sec").over(inside) < gap, 0).otherwise(1)
    partial = (
        df.withColumn("_slice", _slice_of(F.col("sec"), width))
        .withColumn("_step", step)
        .withColumn("_run", F.sum("_step").over(inside))
        .groupBy(*keys, "_slice", "_run")
        .agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"),
             *[fn(col).alias(n) for n, (fn, col) in sums.items()])
    )
    across = Window.partitionBy(*keys).orderBy("first_sec")
    joined = F.when(F.col("first_sec") - F.lag("last_sec").over(across) < gap, 0).otherwise(1)
    return (
        partial.withColumn("_step", joined)
        .withColumn("_run", F.sum("_step").over(across))
        .groupBy(*keys, "_run")
        .agg(F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec"),
             *[fn(n).alias(n) for n, (fn, _) in sums.items()])
        .drop("_run")
    )


def running_sum(df: DataFrame, keys: list[str], value: str, out: str, width: int = DAY) -> DataFrame:
    """Add ``out``: the sum of ``value`` from a key's first second to this one. Seconds are distinct per key.

    Sums run inside slices; what stood before a slice comes from one row per slice.
    """
    sliced = df.withColumn("_slice", _slice_of(F.col("sec"), width))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total")).select(
        *keys, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn(out, F.sum(value).over(inside))
        .join(before.hint("merge"), [*keys, "_slice"])
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_slice", "_before")
    )


def distinct_trailing(df: DataFrame, keys: list[str], value: str, seconds: int, out: str, width: int = DAY) -> DataFrame:
    """``keys, sec, out, since``: how many distinct values occur in ``[sec - seconds, sec]`` and from when on, at every second that has one.

    A value stays in the window from a visit until ``seconds`` after it, so visits no further apart are one stay. The number of
    values is the number of stays begun and not ended: a running sum of steps, with no set of values held anywhere.
    """
    visits = df.filter(F.col(value).isNotNull()).groupBy(*keys, value, "sec").agg(F.lit(1).alias("_one"))
    stays = islands(visits, [*keys, value], seconds + 2, width)
    step = F.array(F.struct(F.col("first_sec").alias("sec"), F.lit(1).alias("_step")),
                   F.struct((F.col("last_sec") + (seconds + 1)).alias("sec"), F.lit(-1).alias("_step")))
    steps = stays.select(*keys, F.explode(step).alias("_s")).select(*keys, "_s.sec", "_s._step", F.lit(0).alias("_seen"))
    rows = steps.unionByName(visits.select(*keys, "sec", F.lit(0).alias("_step"), F.lit(1).alias("_seen")))
    moments = rows.groupBy(*keys, "sec").agg(F.sum("_step").alias("_step"), F.max("_seen").alias("_seen"))
    counted = running_sum(moments, keys, "_step", out, width).filter("_seen = 1").select(*keys, "sec", out)
    return trailing(counted, keys, seconds, width=width, since=F.min("sec"))


def following(df: DataFrame, keys: list[str], steps: int, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``keys, sec, later``: the next ``steps`` distinct seconds of the key after each, as an array.

    Rows are cut into blocks of a key's rows; the first rows of a block also stand at the end of the one before.
    """
    seconds = dense_position(df.select(*keys, "sec").distinct(), keys, "sec", "_n", block)
    own = F.floor(F.col("_n") / block)
    into = F.sequence(F.greatest(own - F.when(F.col("_n") % block < steps, 1).otherwise(0), F.lit(0)), own)
    ahead = Window.partitionBy(*keys, "_part").orderBy("_n").rowsBetween(1, steps)
    return (
        seconds.withColumn("_part", F.explode(into))
        .withColumn("later", F.collect_list("sec").over(ahead))
        .filter(F.col("_part") == own).select(*keys, "sec", "later")
    )


def gap_sums(df: DataFrame, keys: list[str], width: int = DAY) -> DataFrame:
    """Per key the gaps between consecutive distinct seconds: number, sum and sum of squares (gaps, s1, s2), first_sec, last_sec.

    Slices sum their inner gaps; the gaps between slices come from one row per slice. All sums are whole numbers, so
    the result does not depend on the order of combination, and the sums of two spans of time can be added.
    """
    inside = Window.partitionBy(*keys, "_slice").orderBy("sec")
    parts = (
        df.withColumn("_slice", _slice_of(F.col("sec"), width))
        .withColumn("_gap", (F.col("sec") - F.lag("sec").over(inside)).cast("decimal(38,0)"))
        .groupBy(*keys, "_slice")
        .agg(F.min("sec").alias("_first"), F.max("sec").alias("_last"), F.count("_gap").alias("_n"),
             F.sum("_gap").alias("_s1"), F.sum(F.col("_gap") * F.col("_gap")).alias("_s2"))
    )
    across = Window.partitionBy(*keys).orderBy("_slice")
    total = lambda c, gap: (F.coalesce(F.sum(c), F.lit(0)) + F.coalesce(F.sum(gap), F.lit(0))).cast("decimal(38,0)")
    return (
        parts.withColumn("_gap", (F.col("_first") - F.lag("_last").over(across)).cast("decimal(38,0)"))
        .groupBy(*keys)
        .agg((F.sum("_n") + F.count("_gap")).alias("gaps"), total("_s1", F.col("_gap")).alias("s1"),
             total("_s2", F.col("_gap") * F.col("_gap")).alias("s2"), F.min("_first").alias("first_sec"), F.max("_last").alias("last_sec"))
    )


def gap_moments(sums: DataFrame) -> DataFrame:
    """A ``gap_sums`` table with the mean and the population deviation of the gaps in place of their sums."""
    mean, square = (F.try_divide(F.col(c).cast("double"), "gaps") for c in ("s1", "s2"))
    return sums.withColumns({"mean_gap": mean, "dev_gap": F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))}).drop("s1", "s2")


def gap_stats(df: DataFrame, keys: list[str], width: int = DAY) -> DataFrame:
    """Per key the number, mean and population deviation of gaps between consecutive distinct seconds."""
    return gap_moments(gap_sums(df, keys, width))
