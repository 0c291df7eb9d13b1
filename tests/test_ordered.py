"""Blocked and sliced order-dependent work against plain loops, with blocks small enough to be crossed."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators.chunks import assign_chunks, chunk_starts, chunk_table, session_table, summary_line
from emberlog.operators.joins import attach
from emberlog.operators.ordered import dense_position, last_before
from emberlog.operators.requests import rolling_context
from emberlog.operators.slices import gap_stats, islands, trailing


def greedy(tokens, budget):
    out, chunk, filled = [], -1, 0
    for t in tokens:
        if chunk < 0 or filled + t > budget:
            chunk, filled = chunk + 1, 0
        filled += t
        out.append(chunk)
    return out


@pytest.mark.parametrize("block,group", [(1, 2), (7, 3), (64, 1), (10**6, 256)])
def test_chunks_follow_the_sequential_rule(spark, block, group):
    rng = random.Random(block)
    files = {"a": [rng.choice([4, 8, 40, 300]) for _ in range(400)], "b": [1000], "c": [4] * 130, "d": [200, 4, 200, 200]}
    rows = [(f, 3 * i, "x" * n) for f, sizes in files.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "source_file string, line_no bigint, raw string")
    got = assign_chunks(df, budget=30, block=block, group=group).collect()
    assert len(got) == len(rows)
    for f, sizes in files.items():
        mine = sorted((r.line_no, r.chunk_index) for r in got if r.source_file == f)
        assert [c for _, c in mine] == greedy([max(1, n // 4) for n in sizes], 30)


def test_chunk_budget_edges(spark):
    """A chunk may be exactly full; one token more opens the next."""
    rows = [("f", 1, "x" * 3000), ("f", 2, "x" * 3000), ("f", 3, "x"), ("f", 4, "x" * 9000), ("f", 5, "x")]
    df = spark.createDataFrame(rows, "source_file string, line_no bigint, raw string")
    got = assign_chunks(df).orderBy("line_no").collect()
    assert [r.chunk_index for r in got] == [0, 0, 1, 2, 3]
    starts = chunk_starts(df.withColumn("tokens", F.length("raw")), budget=3000).orderBy("chunk_index").collect()
    assert [(r.start, r.chunk_index) for r in starts] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_chunk_table_and_session(spark):
    rows = [("f", 1, "one", "unknown", None), ("f", 2, "two", "syslog", 5), ("g", 1, "x", "unknown", None)]
    df = spark.createDataFrame(rows, "source_file string, line_no bigint, raw string, format string, s bigint").withColumn(
        "event_ts", F.timestamp_seconds("s"))
    chunked = assign_chunks(df)
    table = {r.source_file: r for r in chunk_table(chunked).collect()}
    assert table["f"].chunk_text == "one\ntwo" and table["f"].log_format == "unknown" and table["f"].n_lines == 2
    assert table["g"].timestamp_first is None
    alerts = spark.createDataFrame([("f", "HIGH"), ("f", "HIGH"), ("f", "INFO")], "source_file string, severity string")
    text = {r.source_file: r.summary for r in summary_line(session_table(chunked, alerts)).collect()}
    assert text == {"f": "f | syslog | 2 lines | 1 chunks | 2 high, 1 info", "g": "g |  | 1 lines | 1 chunks | no alerts"}


@pytest.mark.parametrize("block", [1, 5, 1000])
def test_last_before_and_position(spark, block):
    rng = random.Random(block)
    rows = [(k, i, rng.choice([None, None, f"v{i}"])) for k in "ab" for i in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, i bigint, v string")
    got = dense_position(last_before(df, ["k"], "i", "v", "seen", block), ["k"], "i", "pos", block).collect()
    assert len(got) == len(rows)
    for key in "ab":
        last = None
        for pos, r in enumerate(sorted((r for r in got if r.k == key), key=lambda r: r.i)):
            assert (r.seen, r.pos) == (last, pos)
            last = r.v if r.v is not None else last


@pytest.mark.parametrize("block", [1, 65536])
def test_rolling_context_equals_the_sequential_rule(spark, block):
    rng = random.Random(3)
    rows = []
    for key, n, longest in (("short", 300, 3), ("mixed", 80, 400), ("long", 6, 3000), ("none", 5, 0)):
        for i in range(n):
            line = None if longest == 0 or rng.random() < 0.3 else f"[chunk {i}] " + "y" * rng.randint(1, longest)
            rows.append((key, i, line))
    df = spark.createDataFrame(rows, "k string, chunk_index bigint, line string")
    got = {(r.k, r.chunk_index): r.context for r in rolling_context(df, ["k"], block=block).collect()}
    assert len(got) == len(rows)
    state = {}
    for key, i, line in rows:
        assert got[(key, i)] == state.get(key)
        if line is not None:
            text = f"{state[key]}\n{line}" if key in state else line
            state[key] = text if len(text) <= 1500 else "...\n" + text[-1500:]


@pytest.mark.parametrize("width", [10, 37, 86_400])
def test_slices(spark, width):
    rng = random.Random(width)
    rows = [(k, s, rng.randint(1, 4)) for k in "ab" for s in rng.sample(range(-50, 500), 120)]
    df = spark.createDataFrame(rows, "k string, sec bigint, n bigint")
    for until in (0, 1):
        for r in trailing(df, ["k"], 25, until, width, total=F.sum("n")).collect():
            want = [n for k, s, n in rows if k == r.k and r.sec - 25 <= s <= r.sec - until]
            assert r.total == (sum(want) if want else None)
    got = sorted(tuple(r) for r in islands(df, ["k"], 6, width, total=(F.sum, "n"), top=(F.max, "n")).collect())
    want = []
    for key in "ab":
        for k, s, n in sorted(r for r in rows if r[0] == key):
            if want and want[-1][0] == key and s - want[-1][2] < 6:
                _, first, _, total, top = want.pop()
                want.append((key, first, s, total + n, max(top, n)))
            else:
                want.append((key, s, s, n, n))
    assert got == sorted(want)
    for r in gap_stats(df, ["k"], width).collect():
        gaps = np.diff(sorted(s for k, s, _ in rows if k == r.k))
        assert r.gaps == len(gaps) and math.isclose(r.mean_gap, gaps.mean()) and math.isclose(r.dev_gap, gaps.std())


def test_hot_key_join(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    for rows in (0, 100):
        assert attach(big, small, ["k"], max_rows=rows).count() == 335
        assert attach(big, small, ["k"], "left", max_rows=rows).filter("v IS NULL").count() == 665
