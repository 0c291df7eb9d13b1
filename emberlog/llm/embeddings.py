"""Embedding near-dedup: vectors in principal order, compared tile by tile with suffix-norm bounds."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stored, whole_groups
from emberlog.llm.components import components, forest
from emberlog.session import broadcast_if_small

#: Vectors in a tile; leading coordinates that lay out the grid; coordinates added at each step; pairs looked at at once.
TILE, GRID, STEP, PAIRS = 2048, 2, 8, 1 << 16
#: Rotated and plain dot products differ by less than this.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, one at least not 0."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length 1, in double precision."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes of all unit vectors of ``size``, most weight first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                rows = unit(batch.column(0))
                total += rows.T @ rows
        at = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], ["i", "j", "value"])

    # size * (size + 1) / 2 rows, however many vectors there are
    held = vectors.select("vector").mapInArrow(moments, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    moment = np.zeros((size, size))
    for row in held:
        moment[row["i"], row["j"]] = moment[row["j"], row["i"]] = row["value"]
    return np.linalg.eigh(moment)[1][:, ::-1]


def similar_pairs(left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes i, j and dot product of the rows of ``left`` and ``right`` with a dot product of ``threshold`` or more, in pieces.

    Coordinates are added from the first on, a few at a time. What the others can still add is at most the product of the
    norms of the two suffixes; pairs that cannot reach the threshold any more are dropped.
    """
    size = left.shape[1]
    norms = [np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]) for m in (left, right)]
    norms = [np.concatenate([n, np.zeros((len(n), 1))], axis=1) for n in norms]
    least = threshold - SLACK
    for start in range(0, len(left), 512):
        here = slice(start, start + 512)
        lead = min(STEP, size)
        dots = left[here, :lead] @ right[:, :lead].T
        i, j = np.nonzero(dots + norms[0][here, lead, None] * norms[1][None, :, lead] >= least)
        so_far = dots[i, j]
        i = i + start
        for cut in range(0, len(i), PAIRS):
            a, b, dot, at = i[cut:cut + PAIRS], j[cut:cut + PAIRS], so_far[cut:cut + PAIRS], lead
            while at < size and len(a):
                more = min(at + STEP, size)
                dot = dot + np.einsum("ij,ij->i", left[a, at:more], right[b, at:more])
                at = more
                stays = dot + norms[0][a, at] * norms[1][b, at] >= least
                a, b, dot = a[stays], b[stays], dot[stays]
            if len(a):
                yield a, b, dot


def link(nodes: DataFrame, size: int, threshold: float, tile: int = TILE) -> DataFrame:
    """(node, links, root) per tile pair and node with links there: how many vectors it links to, and the least node reached.

    ``nodes`` has node, label, vector (all of ``size``) and copies. Vectors whose cosine reaches the threshold are at most
    sqrt(2 - 2 threshold) apart, so on a grid of that width over the leading principal coordinates they lie in the same or in
    neighbouring cells. Cells of more than ``tile`` vectors are dealt out to tiles by hash, and every two tiles that have to
    meet make a group, which no task needs to hold more than one of.
    """
    axes = principal_axes(nodes, size)
    dims, width = min(GRID, size), float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9) + 1e-12

    @F.arrow_udf("array<long>")
    def cell(vectors: pa.Array) -> pa.Array:
        at = np.floor(unit(vectors) @ axes[:, :dims] / width).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dims, pa.int32()), pa.array(at.ravel()))

    placed = stored(nodes.select("node", "label", "copies", "vector", cell("vector").alias("cell")), "cells")
    sizes = stored(placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("shares")), "cell-sizes")
    ahead = [o for o in product((-1, 0, 1), repeat=dims) if o >= (0,) * dims]
    moved = F.array(*[F.array(*[F.col("cell")[k] + o[k] for k in range(dims)]) for o in ahead])
    meet = stored(sizes.select("label", F.col("cell").alias("one"), F.col("shares").alias("ones"), F.explode(moved).alias("cell")).join(
        sizes, ["label", "cell"]).withColumnsRenamed({"cell": "two", "shares": "twos"}), "meetings")
    near = broadcast_if_small(meet)
    share = lambda shares: F.pmod(F.xxhash64(F.lit(11), "node"), F.col(shares)).cast("int")
    upto = lambda shares: F.explode(F.sequence(F.lit(0), F.col(shares) - 1))
    columns = ["label", "one", "two", "s", "t", "left", "node", "copies", "vector"]
    left = placed.withColumnRenamed("cell", "one").join(near, ["label", "one"]).withColumn("s", share("ones")).withColumn("t", upto("twos")).withColumn(
        "left", F.lit(True)).filter("one <> two or s <= t").select(columns)
    right = placed.withColumnRenamed("cell", "two").join(near, ["label", "two"]).withColumn("t", share("twos")).withColumn("s", upto("ones")).withColumn(
        "left", F.lit(False)).filter("one <> two or s < t").select(columns)
    keys = ["label", *[f"{side}{k}" for side in ("one", "two") for k in range(dims)], "s", "t"]
    flat = left.unionByName(right).select(
        "s", "t", *[F.col(side)[k].alias(f"{side}{k}") for side in ("one", "two") for k in range(dims)],
        F.col("label").cast("string").alias("label"), "left", "node", "copies", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, keys):
            found = []
            for start, end in zip(at[:-1], at[1:]):
                part = rows.slice(start, end - start)
                side = part.column("left").to_numpy(zero_copy_only=False)
                node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
                if end - start < 2 or not side.any():
                    continue
                raw = unit(part.column("vector"))
                turned = raw @ axes
                alone = side.all()  # a tile with itself
                one = np.flatnonzero(side)
                two = one if alone else np.flatnonzero(~side)
                links, edges = np.zeros(len(node), np.int64), []
                for i, j, dot in similar_pairs(turned[one], turned[two], threshold):
                    i, j = one[i], two[j]
                    if alone:
                        i, j, dot = i[i < j], j[i < j], dot[i < j]
                    close = np.abs(dot - threshold) <= SLACK
                    dot[close] = np.einsum("ij,ij->i", raw[i[close]], raw[j[close]])
                    i, j = i[dot >= threshold], j[dot >= threshold]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    root = forest(i, j, len(node))
                    child = np.flatnonzero(root != np.arange(len(node)))
                    edges.append((child, root[child]))
                if links.any():
                    root = forest(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)), len(node))
                    has = links > 0
                    found.append((node[has], links[has], node[root[has]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["node", "links", "root"])

    return flat.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, links long, root long")


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
                    tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept): a row per row of ``rows``.

    Vectors of one label and one length link when their cosine in double precision is ``threshold`` or more. A null label, a
    null or empty vector, a zero vector and one with a null or non-finite component link with nothing: no links, its own
    component. Equal vectors of one label are one node with so many copies, and link with each other. ``component_id`` is the
    least key reachable; ``kept`` marks the row that has it. Rows with the same key are vectors of their own; a null key links
    like others, but is not kept unless nothing else is reached (component null). An empty table gives an empty one.
    """
    kind = rows.schema[key].dataType
    given = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    nodes = stored(given.filter(fit).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least")).withColumn(
        "node", F.monotonically_increasing_id()), "vectors")
    parts = [link(nodes.filter(F.size("vector") == size), size, threshold, tile)
             for size in sorted(r[0] for r in nodes.select(F.size("vector")).distinct().collect())]  # usually one length
    empty = nodes.limit(0).select("node", F.col("copies").alias("links"), F.col("node").alias("root"))
    linked = empty
    for part in parts:
        linked = linked.unionByName(part)
    linked = stored(linked, "links")
    roots = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = nodes.join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
    rooted = stored(counted.select("label", "vector", F.coalesce("root", "node").alias("root"), "least", (
        F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    lookup = stored(rooted.join(least, "root").select("label", "vector", "links", "component"), "lookup")
    found = given.filter(fit).join(lookup, ["label", "vector"]).select("key", "links", "component")
    alone = given.filter(~fit).select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    return found.unionByName(alone).select(
        F.col("key").alias(key), F.col("links").alias("n_links"), F.col("component").cast(kind).alias("component_id"),
        F.col("key").eqNullSafe(F.col("component")).alias("kept"))
