"""Intel feed files: JSON documents with one long array of objects, read by as many tasks as a file has ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.intel import ATTACK_OBJECT, CVE_ITEM
from emberlog.session import materialize
from emberlog.sources.files import file_system

#: Bytes of a range, bytes looked at beyond its ends for a name or a bracket, and bytes of objects that are handed on together.
SPLIT, NEAR, HANDED = 64 << 20, 4096, 4 << 20
QUOTE, BACKSLASH, COLON, OPEN, CLOSE = (ord(c) for c in '"\\:{}')
_DEEPER = np.zeros(256, np.int64)
_DEEPER[[ord(c) for c in "{["]], _DEEPER[[ord(c) for c in "}]"]] = 1, -1


def _marks(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are quotes that open or close a string, and which stand inside of one if the first does not.

    ``escaped``: whether an odd number of backslashes stands before the first byte. Only strings hold backslashes.
    """
    other = np.flatnonzero(data != BACKSLASH)
    before = np.concatenate([[-1], other[:-1]])
    odd = (other - before - 1) % 2 == 1
    if escaped and len(other):
        odd[0] = (other[0] + 1) % 2 == 1
    quotes = np.zeros(len(data), bool)
    quotes[other[(data[other] == QUOTE) & ~odd]] = True
    return quotes, np.cumsum(quotes) % 2 == 1


def _read(path: str, start: int, end: int) -> tuple[np.ndarray, bool]:
    """Bytes of a file, and whether the first is escaped."""
    files, name = file_system(path)
    with files.open_input_file(name) as file:
        near = max(0, start - NEAR)
        file.seek(near)
        data = file.read(end - near)
    head = data[:start - near]
    return np.frombuffer(data, np.uint8)[start - near:], (len(head) - len(head.rstrip(b"\\"))) % 2 == 1


def _each(batches: Iterator[pa.RecordBatch], of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What ``of`` makes of each row. Small ranges come to few rows each, so those of many go on as one batch."""
    for batch in batches:
        held, size = [], 0
        for row in batch.to_pylist():
            for made in of(**row):
                held.append(made)
                size += len(made.get("text", ""))
                if size >= HANDED:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


def _scan(path: str, start: int, end: int) -> Iterator[dict]:
    """How a range changes what follows it: whether a string ends up open, and the depth if it began outside or inside of one."""
    data, escaped = _read(path, start, end)
    quotes, inside = _marks(data, escaped)
    steps = _DEEPER[data]
    yield {"path": path, "start": start, "end": end, "odd": int(quotes.sum() % 2), "outer": int(steps[~inside].sum()), "inner": int(steps[inside].sum())}


def _members(path: str, start: int, end: int, within: int, depth: int, member: str) -> tuple:
    """The bytes of a range, which stand outside of strings, the depth after each, whether a string is open behind them all, where
    members of the top object begin, and whether each is the wanted array."""
    data, escaped = _read(path, start, end)
    quotes, inside = _marks(data, escaped)
    outside = inside if within else ~inside
    outside = outside & ~quotes
    after = depth + np.cumsum(np.where(outside, _DEEPER[data], 0))
    colons = np.flatnonzero(outside & (data == COLON) & (after == 1))
    wanted = np.zeros(len(colons), bool)
    for k, at in enumerate(colons.tolist()):
        around = _read(path, max(0, start + at - NEAR), start + at)[0].tobytes().rstrip()
        name = b'"' + member.encode() + b'"'
        named = around.endswith(name) and not around[:-len(name)].endswith(b"\\")
        wanted[k] = named and _read(path, start + at + 1, start + at + 1 + NEAR)[0].tobytes().lstrip().startswith(b"[")
    return data, outside, after, bool(within ^ int(quotes.sum() % 2)), colons, wanted


def split_list(spark: SparkSession, paths: str | list[str], member: str, element: str, split_bytes: int = SPLIT) -> DataFrame:
    """The objects of the array ``member`` of each file's top object, as columns of the struct type ``element``.

    Three passes over ranges of bytes. The first finds how each range changes depth and quotes, whatever it begins with; sums over
    the ranges before then say what it does begin with. The second finds which member is open where a range begins. In the third
    each range hands on the objects that begin in it, reading the last one to its end. No file is one task's, no range is held
    but by its own task. Files are UTF-8; elements that are no objects are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length").filter("length > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = materialize(ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end")))
    spread = max(1, min(ranges.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = "path string, start long, end long"
    known = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    first = pa.schema([*known, ("odd", pa.int64()), ("outer", pa.int64()), ("inner", pa.int64())])
    scanned = materialize(ranges.repartition(spread).mapInArrow(lambda b: _each(b, _scan, first), f"{place}, odd long, outer long, inner long"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = scanned.withColumn("within", F.pmod(F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2)))
    begun = begun.withColumn("_step", F.when(F.col("within") == 0, F.col("outer")).otherwise(F.col("inner")))
    begun = materialize(begun.withColumn("depth", F.coalesce(F.sum("_step").over(earlier), F.lit(0))).select("path", "start", "end", "within", "depth"))

    def open_member(path, start, end, within, depth):
        *_, wanted = _members(path, start, end, within, depth, member)
        yield {"path": path, "start": start, "end": end, "within": within, "depth": depth, "last": bool(wanted[-1]) if len(wanted) else None}

    second = pa.schema([*known, ("within", pa.int64()), ("depth", pa.int64()), ("last", pa.bool_())])
    named = begun.repartition(spread).mapInArrow(lambda b: _each(b, open_member, second), f"{place}, within long, depth long, last boolean")
    named = materialize(named.withColumn("wanted", F.coalesce(F.last("last", True).over(earlier), F.lit(False))).drop("last"))

    def objects(path, start, end, within, depth, wanted):
        data, outside, after, open_, colons, hits = _members(path, start, end, within, depth, member)
        opens = np.flatnonzero(outside & (data == OPEN) & (after == 3))
        closes = np.flatnonzero(outside & (data == CLOSE) & (after == 2))
        which = np.searchsorted(colons, opens, side="right") - 1
        for at in opens[np.where(which >= 0, hits[np.maximum(which, 0)] if len(hits) else False, wanted)].tolist():
            k = np.searchsorted(closes, at)
            text = data[at:closes[k] + 1].tobytes() if k < len(closes) else data[at:].tobytes() + _rest(
                path, start + len(data), int(after[-1]), open_)
            yield {"text": text.decode("utf-8", "replace")}

    texts = named.repartition(spread).mapInArrow(lambda b: _each(b, objects, pa.schema([("text", pa.string())])), "text string")
    return texts.select(F.from_json("text", element).alias("o")).select("o.*")


def _rest(path: str, start: int, depth: int, inside: bool) -> bytes:
    """From ``start`` on to where the depth is 2 again, a piece at a time, each twice as long as the one before."""
    out, piece = [], NEAR // 2
    while True:
        piece = min(2 * piece, 256 * NEAR)
        data, escaped = _read(path, start, start + piece)
        if not len(data):
            return b"".join(out)
        quotes, odd = _marks(data, escaped)
        outside = (odd if inside else ~odd) & ~quotes
        after = depth + np.cumsum(np.where(outside, _DEEPER[data], 0))
        ends = np.flatnonzero(outside & (data == CLOSE) & (after == 2))
        if len(ends):
            return b"".join([*out, data[:ends[0] + 1].tobytes()])
        out.append(data.tobytes())
        start, depth, inside = start + len(data), int(after[-1]), bool(inside ^ (quotes.sum() % 2 == 1))


def read_attack_bundle(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT) -> DataFrame:
    """Objects of STIX bundles."""
    return split_list(spark, paths, "objects", ATTACK_OBJECT, split_bytes)


def read_cve_feed(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT) -> DataFrame:
    """Items of CVE feeds in the 1.1 JSON layout."""
    return split_list(spark, paths, "CVE_Items", CVE_ITEM, split_bytes)
