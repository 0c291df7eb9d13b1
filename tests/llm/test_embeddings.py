import numpy as np
import pytest

from emberlog.llm import embeddings

SCHEMA = "vec_id long, label int, embedding array<double>, node long, vector string"


def brute(rows, threshold):
    ok = [(k, label, np.array(v)) for k, label, v, *_ in rows
          if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {k: k for k, *_ in rows}, {k: 0 for k, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (ka, la, x), (kb, lb, y) = ok[a], ok[b]
            if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[ka] += 1
                links[kb] += 1
                p, q = find(ka), find(kb)
                root[max(p, q)] = min(p, q)
    return {k: (links[k], find(k), find(k) == k) for k in root}


def rows(n=420, size=12, seed=3):
    r = np.random.default_rng(seed)
    base, out = r.normal(size=(25, size)), []
    for i in range(n):
        v = (base[r.integers(0, 25)] + r.normal(size=size) * r.choice([0, .02, .05, .1, .3])) * r.choice([1, 3.0, 1e150])
        out.append((i, int(r.integers(0, 3)) if r.random() < .95 else None, [float(x) for x in v], None, None))
    more = [None, [0.0] * size, [1.0] * (size - 1) + [None], [1.0] * (size - 1) + [float("nan")], [float("inf")] * size, [], [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [3.0]]
    return out + [(1000 + k, 0, v, None, None) for k, v in enumerate(more)]


@pytest.mark.parametrize("tile,threshold", [(2048, .98), (16, .98), (64, .5), (2048, .9999)])
def test_against_brute_force(spark, tile, threshold):
    data = rows()
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(spark.createDataFrame(data, SCHEMA), threshold=threshold, tile=tile).collect()}
    assert got == brute(data, threshold)


def test_similar_pairs_are_all_pairs():
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 20)) * np.linspace(3, .1, 20)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (.3, .9):
        found = {(i, j) for a, b, _ in embeddings.similar_pairs(x[:600], x[500:], threshold) for i, j in zip(a, b)}
        want = {(i, j) for i, j in zip(*np.nonzero(x[:600] @ x[500:].T >= threshold))}
        assert found >= want and all(x[i] @ x[500 + j] >= threshold - 1e-8 for i, j in found)


def test_repeated_rows_and_null_keys(spark):
    data = [(1, 0, [1.0, 0.0], None, None)] * 2 + [(None, 0, [1.0, 0.0], None, None), (None, 1, [0.0, 1.0], None, None), (2, 1, None, None, None)]
    got = sorted((x.vec_id or 0, x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [(0, 0, None, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
