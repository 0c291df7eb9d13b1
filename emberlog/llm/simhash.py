"""SimHash near-dedup: fingerprints of word shingles, linked when few bits differ, compared bit-sliced."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import stored, whole_groups
from emberlog.llm.components import components, forest

#: Fingerprints compared with as many others at once, at most.
TILE = 2048
BITS = 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one UTF-8 text: a bit is 1 if more than half of the shingles' XXH64 have it; no words: 0."""
    words = (text or b"").lower().split()  # for bytes both know ASCII only
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(run), seed) for run in runs), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start:start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text as a signed long. Null and empty texts have fingerprint 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1).cast(pa.binary()))
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        compute, f"key {docs.schema[key].dataType.simpleString()}, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Vertical storage: row b holds bit b of all fingerprints, 64 fingerprints to a word, the last word filled up with 0."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    bits = np.pad(bits, ((0, 0), (0, -len(fps) % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j) of all fingerprints left[i], right[j] that differ in ``radius`` bits or fewer.

    For every left fingerprint the differences to 64 right ones at a time are counted in bit-sliced counters: bit b's
    difference is added to all 64 counts by carry-save steps. A left fingerprint is given up when all its counts are past the
    radius.
    """
    vertical, width = planes(right), max(1, int(radius).bit_length())
    live = np.arange(len(left))
    full = np.zeros(vertical.shape[1] * 64, np.uint8)
    full[len(right):] = 1
    padding = np.packbits(full, bitorder="little").view("<u8")
    counts = np.zeros((width, len(left), vertical.shape[1]), np.uint64)
    over = np.repeat(padding[None, :], len(left), axis=0)  # lanes past the end count as given up
    for bit in range(BITS):
        flips = (left[live] >> np.uint64(bit) & np.uint64(1)) * np.uint64(0xFFFFFFFFFFFFFFFF)
        carry = vertical[bit][None, :] ^ flips[:, None]
        for k in range(width):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over |= carry
        if bit % 8 == 7:
            past = over | _above(counts, radius)
            keep = (past != np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
            if not keep.all():
                live, over, counts = live[keep], over[keep], counts[:, keep]
            if not len(live):
                return live, live
    within = ~(over | _above(counts, radius))
    rows, lanes = np.nonzero(np.unpackbits(np.ascontiguousarray(within, "<u8").view(np.uint8).reshape(len(live), -1), axis=1, bitorder="little"))
    return live[rows], lanes


def _above(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lanes whose count, given as bit planes, is above ``limit``."""
    above, equal = np.zeros_like(counts[0]), np.full_like(counts[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counts))):
        if limit >> k & 1:
            equal &= counts[k]
        else:
            above |= equal & counts[k]
            equal &= ~counts[k]
    return above


def links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that differ in ``radius`` bits or fewer.

    Cut into radius + 2 blocks, two such fingerprints agree in two blocks at least; each pair of blocks makes a table of
    buckets. A bucket of more than ``tile`` is dealt out to shares by hash and every two shares are compared in a cell of their
    own, so no task holds more than two shares. A cell hands on the links to the least fingerprint of each of its components,
    which keeps what is connected without emitting pairs.
    """
    blocks = radius + 2
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    part = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)
    keys = [F.struct(F.lit(t).alias("table"), part(x).alias("x"), part(y).alias("y")) for t, (x, y) in enumerate(combinations(range(blocks), 2))]
    spread = stored(fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.*", "fp"), "buckets")
    full = spread.groupBy("table", "x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shares = F.ceil(F.col("n") / tile).cast("int")
    share = F.pmod(F.xxhash64(F.lit(7), "fp"), shares).cast("int")
    mine = spread.join(stored(full, "full"), ["table", "x", "y"]).withColumn("_shares", shares).withColumn("_share", share)
    other = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))
    cells = mine.withColumn("_other", other).select(
        "table", "x", "y", F.least("_share", "_other").alias("s"), F.greatest("_share", "_other").alias("t"),
        (F.col("_share") <= F.col("_other")).alias("first"), (F.col("_share") >= F.col("_other")).alias("second"), "fp")
    by = ["table", "x", "y", "s", "t"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, by):
            fp = rows.column("fp").to_numpy().view(np.uint64)
            first, second = rows.column("first").to_numpy(), rows.column("second").to_numpy()
            out = []
            for start, end in zip(at[:-1], at[1:]):
                here, own, theirs = fp[start:end], first[start:end], second[start:end]
                i, j = close_pairs(here[own], here[theirs], radius)
                root = forest(np.flatnonzero(own)[i], np.flatnonzero(theirs)[j], len(here))
                child = np.flatnonzero(root != np.arange(len(here)))
                out.append((here[child], here[root[child]]))
            a, b = (np.concatenate([o[k] for o in out]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component): all rows of ``docs``; component is the least key reachable over links, its own included.

    Texts are taken whole, ASCII letters lower-cased; a text with fewer words than a shingle is one shingle, one without words
    has fingerprint 0, which links like any other, as do null texts. Equal fingerprints are one node, so copies cost a row each
    and no pairs. Rows with a null key link and bridge like others and get their component's least key (null if it has none).
    """
    rows = stored(fingerprints(docs, key, text, shingle, seed), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    linked = components(links(nodes.select("fp"), radius))
    rooted = stored(nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), "least")
    lookup = stored(rooted.join(least, "root").select("fp", "component"), "lookup")
    return rows.join(lookup, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component")
