"""Running values over an ordered key of any length.

A window over a whole key would put a hot key into one task. Here rows are cut into blocks of the order value, windows
run inside blocks, and what has to cross from one block to the next travels in a table of one row per block. That table is
merge-joined: the rows are partitioned and sorted by block already, so it is the only side that moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 65_536


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / block))


def last_before(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at a strictly smaller ``order`` of the same key."""
    rows = _blocked(df, order, block)
    tails = rows.groupBy(*keys, "_block").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(*keys, "_block", F.last("_tail", True).over(earlier).alias("_head"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn(out, F.last(value, True).over(inside))
        .join(heads.hint("merge"), [*keys, "_block"])
        .withColumn(out, F.coalesce(out, "_head"))
        .drop("_block", "_head")
    )


def dense_position(df: DataFrame, keys: list[str], order: str, out: str, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... per key in the order of a unique ``order`` column."""
    rows = _blocked(df, order, block)
    sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .join(offsets.hint("merge"), [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.col("_rn") - 1)
        .drop("_block", "_rn", "_before")
    )
