import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import fmindex, queries, spelling
from helpers import DOCS, awkward, frame

SCHEMA = "word string, n long"


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:j] + v[j + 1:] == u for j in range(len(v)))


def brute(words, ratio=10):
    """word: (form, root, n, n_near, form_n), every word against every other."""
    n, out = dict(words), {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form is not None else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (form, root, *rest)
    return out


def grouped(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_words(seed, letters, shortest, longest, count):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(shortest, longest + 1))) for _ in range(count)}
    return [(w, 10 ** r.randrange(6) + r.randrange(3)) for w in sorted(words)]


@pytest.mark.parametrize("seed", range(20))
def test_index_finds_every_word_one_error_away_once(seed):
    words = [w for w, _ in some_words(seed, "abé"[:2 + seed % 2], 2, 7, 120)]
    index, every, found = fmindex.Index(words), np.arange(len(words)), []
    for more in (0, 1):
        size, longer = index.lengths + more, np.full(len(words), bool(more))
        for way, first in ((index, size // 2), (index.reverse(), size - size // 2)):
            found += [p for a, b in fmindex.one_error(way, every, longer, first, size) for p in zip(a.tolist(), b.tolist())]
    assert sorted(found) == sorted((i, j) for i, u in enumerate(words) for j, v in enumerate(words) if near(u, v))


def test_extending_both_ways_keeps_both_intervals():
    words = ["abra", "cadabra", "bracket", "abrab"]
    index = fmindex.Index(words)
    text = "#" + "#".join(words) + "#"
    code = lambda c: np.array([1 if c == "#" else 2 + sorted(set("".join(words))).index(c)])
    for pattern, start in (("abra", 1), ("#abra#", 3), ("bra", 2), ("ra#c", 0), ("zz"[:0] + "kk", 0), ("a", 0)):
        found, other = index.all(1), index.all(1)
        for c in reversed(pattern[:start]):
            found = index.extend_left(found, code(c))
        for c in pattern[start:]:
            found = index.extend_right(found, code(c))
        for c in pattern:
            other = index.extend_right(other, code(c))
        assert found.size[0] == other.size[0] == sum(text.startswith(pattern, i) for i in range(len(text)))
        if found.size[0]:
            assert (found.at[0], found.back[0]) == (other.at[0], other.back[0])


@pytest.mark.parametrize("crowd", [2, 5, 4096])
def test_against_brute_force(spark, crowd):
    """Groups of words with equal halves, cut to the last letter when a group may hold two."""
    rows = [*some_words(3, "abé", 5, 8, 250), *((f"common{w}", n) for w, n in some_words(4, "xyz", 1, 4, 60)), ("a", 5), ("b", 500), ("é" * 300, 1), ("é" * 301, 10)]
    got = grouped(spelling.group_variants(spark.createDataFrame(rows, SCHEMA), crowd=crowd))
    assert got == brute(rows)
    assert any(root not in (form, word) for word, (form, root, *_) in got.items())


def test_small_pieces(spark, monkeypatch):
    """The same when an index holds a few words, a block of look-ups two, and letters are always tried."""
    monkeypatch.setattr(spelling, "ROWS", 10)
    monkeypatch.setattr(fmindex, "BLOCK", 2)
    rows = some_words(8, "abc", 6, 7, 60)
    assert grouped(spelling.group_variants(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_awkward_rows(spark):
    docs = frame(spark, awkward([(30, "Größe größe GRÖßE cafés×x", "de", "a", 1, "x", 1, "p")]))
    words = spelling.vocabulary(spelling.runs(docs), least=1, times=1)
    texts = [t for _, t, *_ in awkward() if t] + ["Größe größe GRÖßE cafés×x"]
    lower = str.maketrans(spelling.CAPITALS, spelling.SMALL)
    want = Counter(w for t in texts for w in re.findall("[A-Za-zÀ-ÿ]+", t.translate(lower)))
    assert {r.word: r.n for r in words.collect()} == want
    assert "grÖße" in want and want["größe"] == 3  # A to Z only
    rows = [(None, 3), ("", 9), ("x", 1), ("xy", 20)]
    assert grouped(spelling.group_variants(spark.createDataFrame(rows, SCHEMA))) == {
        None: (None, None, 3, 0, None), "": (None, "", 9, 0, None), "x": ("xy", "xy", 1, 1, 20), "xy": (None, "xy", 20, 1, None)}
    with pytest.raises(ValueError):
        spelling.group_variants(words, ratio=1)


def test_empty_table(spark):
    assert spelling.group_variants(spelling.vocabulary(spelling.runs(frame(spark, [], DOCS)))).count() == 0


def test_query(spark):
    """The query's rule on real rows, its pairs found by deleted letters."""
    sf = "/root/testdata/sf0.001"
    counts = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", (r.text or "").translate(str.maketrans(spelling.CAPITALS, spelling.SMALL))):
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    got = grouped(queries.op11_spelling(spark, sf))
    assert {w: r[2] for w, r in got.items()} == n
    cut = {}
    for w in n:
        for j in range(len(w)):
            cut.setdefault((j, w[:j] + w[j + 1:]), set()).add(w)
    pairs = {(u, v) for group in cut.values() for u in group for v in group if u != v}
    pairs |= {p for (_, rest), group in cut.items() if rest in n for w in group for p in ((w, rest), (rest, w))}
    assert Counter(u for u, _ in pairs) == {w: r[3] for w, r in got.items() if r[3]}
