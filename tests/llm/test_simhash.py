import numpy as np
import pytest
import xxhash

from emberlog.llm import components, simhash
from helpers import LONG, awkward, frame, prose


def plain(text):
    """The fingerprint bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "One", "one TWO", "Ünï Ö x y z", prose(1, 300), "a " * 70_000, "x\ty\x0bz\x0cq"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("n,m", [(1, 1), (3, 70), (90, 128), (130, 64)])
def test_close_pairs(n, m, radius):
    r = np.random.default_rng(n + radius)
    base = r.integers(0, 2**63, 9, dtype=np.uint64)
    draw = lambda k: base[r.integers(0, 9, k)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (k, 3)).astype(np.uint64), axis=1)
    left, right = draw(n), draw(m)
    want = set(zip(*np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)))
    assert set(zip(*simhash.close_pairs(left, right, radius))) == want


def grouped(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("tile", [2048, 8])
def test_links_connect_what_is_near(spark, tile):
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(0, 2**63, 12)]
    fps = sorted({base[i % 12] ^ sum(1 << int(b) for b in set(r.integers(0, 64, i % 6))) for i in range(300)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    near = [(a, b) for a, x in zip(signed, fps) for b, y in zip(signed, fps) if a < b and (x ^ y).bit_count() <= 2]
    got = {x.node: x.root for x in components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), tile=tile)).collect()}
    want = grouped(signed, near)
    linked = {n for e in near for n in e}
    assert got == {n: want[n] for n in linked}


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (700, 701), (701, 700)] + [(2000, 2000 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 700: 700, 701: 700, **{2000 + k: 2000 for k in range(50)}}


def test_awkward_rows(spark):
    rows = awkward([(30, LONG + " more", "en", "c", 0, "x", 6, "p"), (31, "ONE two  three four.\tfive six.", None, None, None, None, None, None)])
    got = [(r.doc_id, r.fingerprint, r.component) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    prints = {}
    for r in rows:
        prints.setdefault(r[0], plain(r[1]))
    assert len(got) == len(rows) and all(f == f"{prints[k]:016x}" for k, f, _ in got if k is not None)
    by = {k: c for k, _, c in got}
    assert by[31] == 1 and by[2] == by[3] == by[4] == by[10] == 2 and by[7] == 7
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
