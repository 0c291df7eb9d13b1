"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.session import scratch_path

#: A word: a run of anything but the blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that no lost executor takes away."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table written by ``stored`` that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hidden(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns _c0, _c1, ..., and the new name of each, so that no helper column can clash with one of them."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str], added: dict[str, Column], without: str | None = None) -> DataFrame:
    """The columns of before under their names, then ``added``, which take the place of columns of the same name in any case."""
    new = {c.lower() for c in added} | ({without.lower()} if without else set())
    return df.select(*[F.col(inner).alias(c) for c, inner in names.items() if c.lower() not in new], *[v.alias(c) for c, v in added.items()])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``by`` as tables of whole groups, with where each group starts and, last, where the table ends.

    Holds the rows of the group that is still open and of one batch.
    """
    held: list[pa.RecordBatch] = []

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows) - 1, bool)
        for c in by:
            column = rows.column(c).combine_chunks()
            codes = (column if pa.types.is_integer(column.type) and not column.null_count else column.dictionary_encode().indices.fill_null(-1)).to_numpy(zero_copy_only=False)
            new |= codes[1:] != codes[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held)
        at = starts(rows)
        if at[-1]:
            yield rows.slice(0, at[-1]), at
        held = rows.slice(at[-1]).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.append(starts(rows), len(rows))
