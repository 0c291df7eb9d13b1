import hashlib
import re
from collections import defaultdict

import pytest

from emberlog.llm import mixing
from helpers import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes, weights, epochs):
    """Targets by clamping and sharing out again until nothing is above its cap."""
    left, open_, target = sum(sizes.values()), dict(weights), {}
    while open_:
        per = left / sum(open_.values())
        over = {s for s, w in open_.items() if w * per > epochs * sizes[s] + 1e-9}
        if not over:
            return target | {s: w * per for s, w in open_.items()}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_against_brute_force(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", "abcdefg"[min(6, i % 13)], 0, "", 0, "") for i in range(900)]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    want = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}, 3)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 45  # half of the largest document
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(got) == sorted(again)
    other = mixing.mix(frame(spark, rows), seed=1).collect()
    assert sorted(got) != sorted(other)


def test_caps_are_reshared(spark):
    rows = [(i, "w w", "en", "abz"[min(2, i)], 0, "", 0, "") for i in range(200)]  # a and b are tiny
    got = {r.source: r.target for r in mixing.mix(frame(spark, rows)).collect()}
    assert got["a"] == 6 and got["b"] == 6 and got["z"] == pytest.approx(388)


def test_awkward_rows(spark):
    docs = frame(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = {(r.doc_id, r.source): r.size for r in got}
    assert sizes[2, "b"] == sizes[3, "a"] == 0 and sizes[5, "c"] == 60_000 and sizes[9, "b"] == 2
    taken = mixing.take(docs)
    assert taken.columns == [*docs.columns, "repetition_"]
    copies = {(r.doc_id, r.source, hashlib.md5(str(r.size).encode()).hexdigest()): r.copies for r in got}
    assert taken.count() == sum(r.copies for r in got) and all(c <= 3 for c in copies.values())


def test_empty_table(spark):
    empty = frame(spark, [])
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
