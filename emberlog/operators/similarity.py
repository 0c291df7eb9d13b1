"""Exact top-n neighbours by cosine similarity.

The corpus is a threat-intelligence table, small next to the logs. Counted within ``corpus_bytes`` it is broadcast once
as a matrix and every batch of query vectors is scored by one matrix product, without moving a query row. A larger
corpus is cut into blocks and the queries into shards; each (block, shard) cell is scored alone and hands on only
its n best per query, from which the final n are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.schema import INTEL_TOP_N

CORPUS_BYTES = 256 * 2**20
CELL_CORPUS_ROWS = 100_000
CELL_QUERY_ROWS = 100_000
_SCORE_CELLS = 2**22
DECIMALS = 9  # scores are compared after rounding, so equal vectors tie whatever the order of summation


def _unit(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    if m.size == 0:
        return m.reshape(0, 0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best(query_ids, queries: np.ndarray, corpus_ids: np.ndarray, corpus: np.ndarray, n: int,
          exclude_self: bool) -> pd.DataFrame:
    """The n best of a corpus sorted by id for every query; ties go to the smaller id."""
    out_q, out_c, out_s, out_r = [], [], [], []
    step = max(1, _SCORE_CELLS // max(1, len(corpus_ids)))
    for at in range(0, len(query_ids), step):
        scores = np.round(queries[at:at + step] @ corpus.T, DECIMALS)
        for row, qid in zip(scores, query_ids[at:at + step]):
            if exclude_self:
                row = np.where(corpus_ids == qid, -np.inf, row)
            k = min(n, len(row))
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
            top = near[np.argsort(-row[near], kind="stable")][:k]
            top = top[row[top] > -np.inf]
            out_q.extend([qid] * len(top))
            out_c.extend(corpus_ids[top])
            out_s.extend(row[top])
            out_r.extend(range(1, len(top) + 1))
    return pd.DataFrame({"query_id": out_q, "intel_id": out_c, "rank": np.asarray(out_r, dtype="int64"),
                         "score": np.asarray(out_s, dtype="float64")})


def cosine_topk(queries: DataFrame, corpus: DataFrame, n: int = INTEL_TOP_N, query_id: str = "id",
                corpus_id: str = "id", vector: str = "embedding", exclude_self: bool = False,
                corpus_bytes: int = CORPUS_BYTES) -> DataFrame:
    """``query_id, intel_id, rank, score``: rank 1 is the most similar; fewer than n rows when the corpus is smaller."""
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    c = corpus.select(F.col(corpus_id).alias("intel_id"), F.col(vector).alias("vector"))
    types = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *c.schema.fields]}
    schema = f"query_id {types['query_id']}, intel_id {types['intel_id']}, rank bigint, score double"

    size = c.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).first()
    if size["rows"] * size["dim"] * 8 <= corpus_bytes:
        return _against_broadcast(q, c, n, exclude_self, schema)
    found = _by_cells(q, c, n, exclude_self, schema, size["rows"])
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("intel_id"))
    return (
        found.withColumn("rank", F.row_number().over(ranked).cast("bigint"))
        .filter(F.col("rank") <= n)
        .select("query_id", "intel_id", "rank", "score")
    )


def _against_broadcast(q: DataFrame, c: DataFrame, n: int, exclude_self: bool, schema: str) -> DataFrame:
    rows = c.toPandas().sort_values("intel_id")
    held = q.sparkSession.sparkContext.broadcast((rows["intel_id"].to_numpy(), _unit(rows["vector"])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = held.value
        for batch in batches:
            if len(ids) and len(batch):
                yield _best(batch["query_id"].to_numpy(), _unit(batch["vector"]), ids, matrix, n, exclude_self)

    return q.mapInPandas(score, schema)


def _by_cells(q: DataFrame, c: DataFrame, n: int, exclude_self: bool, schema: str, corpus_rows: int) -> DataFrame:
    blocks = max(1, -(-corpus_rows // CELL_CORPUS_ROWS))
    shards = max(1, -(-q.count() // CELL_QUERY_ROWS))

    def spread(df: DataFrame, key: str, own: str, parts: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))

    left = spread(q, "query_id", "_shard", shards, "_block", blocks).groupBy("_block", "_shard")
    right = spread(c, "intel_id", "_block", blocks, "_shard", shards).groupBy("_block", "_shard")

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "intel_id": [], "rank": [], "score": []})
        b = b.sort_values("intel_id")
        return _best(a["query_id"].to_numpy(), _unit(a["vector"]), b["intel_id"].to_numpy(), _unit(b["vector"]),
                     n, exclude_self)

    return left.cogroup(right).applyInPandas(cell, schema)


def text_vectors(df: DataFrame, text: str = "text", out: str = "embedding", dimensions: int = 256) -> DataFrame:
    """Default vectors where no embedding table is given: hashed word counts weighted by rarity, unit length."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    steps = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ])
    return steps.fit(df).transform(df).withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_idf", "_unit")


def snippets(chunks: DataFrame, neighbours: DataFrame, intel: DataFrame, chunk_id: str = "id") -> DataFrame:
    """Add ``snippets``: the texts of each chunk's neighbours in rank order; empty where there are none."""
    from emberlog.operators.joins import attach

    texts = attach(neighbours, intel.select(F.col("id").alias("intel_id"), "text"), ["intel_id"])
    lists = texts.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("snippets"))
    joined = chunks.join(lists.withColumnRenamed("query_id", chunk_id), chunk_id, "left")
    return joined.withColumn("snippets", F.coalesce("snippets", F.array().cast("array<string>")))
