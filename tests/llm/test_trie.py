import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """convs: conv_id -> list of (role, text). A row per prefix, every conversation against every prefix."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        kids = lambda p: sum(q[:-1] == p for q in nodes if len(q) == len(p) + 1)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        rows.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids(path), sum(kids(p) == 0 for p in below),
                  sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def tried(spark, convs):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    df = trie.conversations(spark.createDataFrame(rows, SCHEMA))
    none = [(c,) for c, turns in convs.items() if not turns]
    if none:
        df = df.unionByName(spark.createDataFrame(none, "conv_id long").withColumn("turns", F.lit(None).cast(df.schema["turns"].dataType)).withColumn(
            "turns", F.coalesce("turns", F.array().cast(df.schema["turns"].dataType))))
    got = [tuple(r) for r in trie.prefix_trie(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some(seed, n, letters, longest):
    r = random.Random(seed)
    return {c * 3: [("user" if i % 2 else "bot", r.choice(letters) * (1 + i % 3)) for i in range(r.randrange(longest + 1))] for c in range(n)}


@pytest.mark.parametrize("seed, n, letters, longest", [(1, 60, "ab", 9), (2, 80, "a", 40), (3, 40, "abcdefgh", 4), (4, 25, "éß日", 17)])
def test_against_brute_force(spark, seed, n, letters, longest):
    convs = some(seed, n, letters, longest)
    assert tried(spark, convs) == brute(convs)


def test_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 3)
    long = [("user", f"t{i}") for i in range(150)]
    convs = {c: long[:4] for c in range(100, 190)} | {1: long, 2: long[:149], 3: [*long[:70], ("bot", "other")], 4: [], 5: [], 6: long[:1]}
    assert tried(spark, convs) == brute(convs)


def test_nodes_hang_together(spark):
    """Edges join end to end, a node is hashed at the two-fattest depth of its edge, and every sequence ends at a node."""
    rows = [(c, i, role, text) for c, turns in some(7, 60, "abc", 12).items() for i, (role, text) in enumerate(turns)]
    seqs = trie.sequences(trie.conversations(spark.createDataFrame(rows, SCHEMA)))
    distinct = seqs.withColumn("m", F.size("path")).filter("m > 0").dropDuplicates(["sid"]).cache()
    nodes = trie.build(distinct.select("sid", "m", "path")).collect()
    ends, paths = {bytes(n.end): n for n in nodes}, {bytes(r.sid): r.path for r in distinct.collect()}
    assert len(ends) == len(nodes) and set(paths) <= set(ends)
    for n in nodes:
        path = [bytes(t.fp) for t in paths[bytes(n.sid)]]
        assert [bytes(t.fp) for t in n.edge] == path[n.low:n.high] and bytes(n.name) == path[n.low] and bytes(n.handle) == path[n.hand - 1]
        assert n.hand == max(range(n.low + 1, n.high + 1), key=lambda k: k & -k)
        assert (n.above is None and n.low == 0) or ends[bytes(n.above)].high == n.low
    inner = {bytes(n.above) for n in nodes if n.above}
    assert all(bytes(n.end) in paths or sum(bytes(m.above or b"") == bytes(n.end) for m in nodes) > 1 for n in nodes)
    assert set(ends) - inner <= set(paths)


def test_awkward_rows(spark):
    """Null ids are no conversation, null turns come first, null roles and texts are empty, repeated rows are repeated turns."""
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 2, "b", "tie"), (1, 2, "a", "tie"),
            (2, 5, "user", "first"), (2, 6, "", ""), (-3, 1, "user", "first" * 20_000)]
    convs = {1: [("user", "first"), ("", ""), ("", ""), ("a", "tie"), ("b", "tie")], 2: [("user", "first"), ("", "")], -3: [("user", "first" * 20_000)]}
    got = trie.prefix_trie(trie.conversations(spark.createDataFrame(rows, SCHEMA).withColumn("KEY", F.lit(1)).withColumn("sid", F.lit("x"))))
    assert {tuple(r) for r in got.collect()} == brute(convs)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema][:3] == [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint")]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.conversations(empty)).count() == 0
    assert tried(spark, {9: [], 4: []}) == brute({9: [], 4: []})


def test_query(spark):
    """The query's rebuilt conversations, on given rows."""
    sf, said = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    turns = {c: [(role, text) for _, role, text in sorted(t)] for c, t in said.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    convs = {c: turns.get(c - c % 100, [])[:h[c]] + turns[c][h[c]:] for c in turns}
    assert {tuple(r) for r in queries.op12_prefix_trie(spark, sf).collect()} == brute(convs)
