"""Postings beside stored alerts: which alerts hold a piece of text or an indicator, without reading all of them.

Every batch of alerts can have an index folder of its own, dealt into buckets by the hash of the term: trigrams of the texts,
whole indicators, and alert ids (where the newest row of an alert stands). The alerts of a batch are numbered in pieces, each
of which a task turns into lists of its own by one sort, so no posting is moved between tasks. A search reads the buckets of
its terms, intersects the lists piece by piece, looks up the ids of what is left, and then reads only the folders of alerts
that hold a candidate; each is tested again on its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import alerts as ops
from emberlog.schema import ALERT, conform
from emberlog.session import broadcast_if_small, materialize
from emberlog.sources.alert_tables import BATCH, folder, read_alerts

#: Kinds of terms; a piece's row (term: its number) lists the ids of its alerts by place.
IDS, IOCS, TRIGRAMS, PIECES = 0, 1, 2, 3
BUCKETS = 16
#: Alerts of a piece, bytes of a piece (its last alert may go beyond); trigrams that a search intersects; folders of alerts, and
#: pieces, that it names one by one.
LISTED, BYTES, ASKED, FOLDERS = 50_000, 8 << 20, 4, 1000
#: Ids have the severity and time of their alert, pieces have ids, other terms have the places of their alerts in a piece.
_ROW = "kind int, term string, piece bigint, places array<int>, ids array<string>, severity string, generated_at timestamp"
POSTINGS = f"feed string, batch_id bigint, bucket int, {_ROW}"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def _pieces(batches: Iterator[pa.RecordBatch], listed: int, size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while len(batch):
            room = listed - sum(map(len, held))
            part = batch.slice(0, min(room, max(1, len(batch) * size // max(1, batch.nbytes))))
            batch = batch.slice(len(part))
            held.append(part)
            if len(part) == room or sum(h.nbytes for h in held) >= size:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _lists(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct terms (numbers from 0) in order, and the distinct rows of each in order."""
    bits = int(rows.max(initial=0)).bit_length()
    if int(terms.max(initial=0)) >> (62 - bits):
        names, terms = np.unique(terms, return_inverse=True)
    else:
        names = None
    pairs = np.sort(terms.astype(np.int64) << bits | rows)
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    terms = pairs >> bits
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pairs)), pa.int32()), pa.array(pairs & ((1 << bits) - 1), pa.int32()))
    return terms[starts] if names is None else names[terms[starts]], places


def _trigrams(texts: list[str], rows: np.ndarray) -> tuple[pa.Array, pa.ListArray]:
    """The trigrams of texts, ASCII letters folded, and the rows of each; ``rows`` has the row of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    codes = codes + np.where((codes >= ord("A")) & (codes <= ord("Z")), 32, 0).astype(np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    known = np.zeros(0x110000, bool)
    known[codes] = True
    letters, ranks = np.flatnonzero(known), np.cumsum(known)[codes] - 1
    n = max(1, len(letters))
    whole = np.flatnonzero(text[:-2] == text[2:])
    grams, places = _lists((ranks[whole] * n + ranks[whole + 1]) * n + ranks[whole + 2], rows[text[whole]])
    shown = letters[np.stack([grams // (n * n), grams // n % n, grams % n], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([shown[i:i + 3] for i in range(0, len(shown), 3)], pa.string()), places


def _indicators(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The indicators of a piece that are no nulls, and the row of each."""
    values, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    there = values.is_valid()
    return values.filter(there), rows[there.to_numpy(zero_copy_only=False)].astype(np.int64)


def _index(piece: pa.Table, number: int) -> Iterator[dict]:
    """The rows of the index of one piece as columns by kind."""
    ids, iocs = (piece.column(c).combine_chunks() for c in ("id", "iocs"))
    yield {"kind": IDS, "term": ids, "severity": piece.column("severity").combine_chunks(), "generated_at": piece.column("generated_at").combine_chunks()}
    yield {"kind": PIECES, "term": pa.array([str(number)]), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
    values, owners = _indicators(iocs)
    coded = values.dictionary_encode()
    terms, places = _lists(coded.indices.to_numpy(zero_copy_only=False), owners)
    yield {"kind": IOCS, "term": coded.dictionary.take(pa.array(terms)), "places": places}
    texts, rows = values.to_pylist(), [owners]
    for c in ("title", "description"):
        texts += [t or "" for t in piece.column(c).to_pylist()]
        rows.append(np.arange(len(piece)))
    terms, places = _trigrams(texts, np.concatenate(rows))
    yield {"kind": TRIGRAMS, "term": terms, "places": places}


def write_index(spark: SparkSession, path: str, batch_id: int, feed: str = BATCH) -> None:
    """Index one stored batch of alerts; indexing it again replaces its index.

    A list holds places in one piece of LISTED alerts, so a term that many alerts hold has many lists. Small files are read
    together, a piece or more a task, since every task writes a file per bucket.
    """
    alerts = spark.read.schema(ALERT).parquet(folder(path, "alerts", batch_id, feed))
    alerts = alerts.coalesce(max(1, alerts.count() // LISTED))
    listed, size = LISTED, BYTES

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for k, piece in enumerate(_pieces(batches, listed, size)):
            types = {"kind": pa.int32(), "term": pa.string(), "piece": pa.int64(), "places": pa.list_(pa.int32()), "ids": pa.list_(pa.string()), "severity": pa.string(),
                     "generated_at": piece.schema.field("generated_at").type}
            for columns in _index(piece, first + k):
                n = len(columns["term"])
                same = {"kind": pa.array(np.full(n, columns.pop("kind")), pa.int32()), "piece": pa.array(np.full(n, first + k), pa.int64())}
                arrays = same | {c: a.cast(types[c]) for c, a in columns.items()}
                yield pa.RecordBatch.from_arrays([arrays[c] if c in arrays else pa.nulls(n, t) for c, t in types.items()], list(types))

    rows = alerts.select("id", "severity", "title", "description", "iocs", "generated_at").mapInArrow(index, _ROW).filter("term IS NOT NULL")
    rows.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("kind", "bucket", "term").write.mode("overwrite").partitionBy("kind", "bucket").parquet(
        folder(path, "index", batch_id, feed))


def postings(spark: SparkSession, path: str, kind: int, terms: list[str]) -> DataFrame:
    """The lists of ``terms``; only their buckets are read."""
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/index")
    return stored.filter((F.col("kind") == kind) & F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _current(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """The alerts of ``hits`` (id, feed, batch_id) that are the newest row of their id."""
    ids = hits.select(F.col("id").alias("term"), _bucket(F.col("id")).alias("bucket")).distinct()
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/index").filter(F.col("kind") == IDS)
    versions = stored.join(ids, ["bucket", "term"], "left_semi").select("feed", "batch_id", F.col("term").alias("id"), "severity", "generated_at")
    newest = Window.partitionBy("id").orderBy(F.col("batch_id").desc(), F.col("generated_at").desc(), "feed")
    last = versions.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "generated_at")
    found = materialize(last.join(hits.select("id", "feed", "batch_id").distinct(), ["id", "feed", "batch_id"], "left_semi"))
    places = found.select("feed", "batch_id", "severity").distinct().limit(FOLDERS + 1).collect()
    key = ["feed", "batch_id", "severity", "id"]
    if not places:
        return spark.createDataFrame([], ALERT)
    if len(places) > FOLDERS:
        stored = spark.read.schema(f"feed STRING, batch_id BIGINT, {_columns()}").parquet(f"{path}/alerts")
        return conform(stored.join(broadcast_if_small(found), key, "left_semi"), ALERT)
    parts = [spark.read.schema(ALERT).parquet(f"{folder(path, 'alerts', p['batch_id'], p['feed'])}/severity={p['severity']}").withColumns(
        {c: F.lit(p[c]) for c in ("feed", "batch_id", "severity")}) for p in places]
    rows = reduce(DataFrame.unionByName, parts).join(broadcast_if_small(found), key, "left_semi")
    # two rows of one id in one batch: the newest one counts
    twice = Window.partitionBy("id").orderBy(F.col("generated_at").desc())
    return conform(rows.withColumn("_rn", F.row_number().over(twice)).filter("_rn = 1").drop("_rn"), ALERT)


def _columns() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALERT.fields)


def _hits(spark: SparkSession, path: str, lists: DataFrame) -> DataFrame:
    """The alerts (id, feed, batch_id) at the places of lists (feed, batch_id, piece, places)."""
    lists = materialize(lists)
    pieces = [str(r["piece"]) for r in lists.select("piece").distinct().limit(FOLDERS + 1).collect()]
    if not pieces:
        return spark.createDataFrame([], "id string, feed string, batch_id bigint")
    named = postings(spark, path, PIECES, pieces) if len(pieces) <= FOLDERS else spark.read.schema(POSTINGS).parquet(f"{path}/index").filter(F.col("kind") == PIECES)
    joined = lists.join(named.select("feed", "batch_id", "piece", "ids"), ["feed", "batch_id", "piece"])
    return materialize(joined.select(F.explode(F.transform("places", lambda i: F.get("ids", i))).alias("id"), "feed", "batch_id").distinct())


def find_text(spark: SparkSession, path: str, term: str, limit: int = ops.TEXT_LIMIT) -> DataFrame:
    """Newest alerts with ``term`` in title, description or an indicator, as ``alerts.by_text`` finds them.

    Of the term's trigrams the ASKED rarest are intersected. A term of fewer than three characters has none, so all alerts are
    read.
    """
    folded = term.translate(str.maketrans(_CAPITALS, _SMALL))
    grams = sorted({folded[i:i + 3] for i in range(len(folded) - 2)})
    if not grams:
        return ops.by_text(read_alerts(spark, path), term, limit)
    counts = {r["term"]: r["n"] for r in postings(spark, path, TRIGRAMS, grams).groupBy("term").agg(F.sum(F.size("places")).alias("n")).collect()}
    if len(counts) < len(grams):
        return spark.createDataFrame([], ALERT)
    asked = sorted(grams, key=lambda g: (counts[g], g))[:ASKED]
    lists = postings(spark, path, TRIGRAMS, asked).groupBy("feed", "batch_id", "piece").agg(F.collect_list("places").alias("_lists")).filter(F.size("_lists") == len(asked))
    places = F.aggregate(F.slice("_lists", 2, len(asked)), F.get("_lists", F.lit(0)), F.array_intersect)
    lists = lists.select("feed", "batch_id", "piece", places.alias("places")).filter(F.size("places") > 0)
    return ops.by_text(_current(spark, path, _hits(spark, path, lists)), term, limit)


def find_ioc(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Newest alerts with the indicator ``value``, as ``alerts.by_ioc`` finds them; one bucket of indicators is read."""
    lists = postings(spark, path, IOCS, [value]).select("feed", "batch_id", "piece", "places")
    return ops.by_ioc(_current(spark, path, _hits(spark, path, lists)), value)
