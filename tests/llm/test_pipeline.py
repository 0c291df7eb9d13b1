"""The pipeline on a small corpus with planted cases, stage by stage, and its result against plain Python."""

import os
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from emberlog.llm import decontam, langid, mixing, simhash
from helpers import awkward, frame
from test_decontam import brute as leaks
from test_linededup import brute as dedup

WORDS = {"en": "the cat and dog were in house with ring thing other that", "de": "der hund und die katze sind nicht im großen haus für sich"}
NAMES = [name for name, _ in corpus_pipeline.STAGES]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang].split()) + r.choice(["", "ing", "er", "s"]) + str(r.randrange(9) or "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, rows = random.Random(7), []
    shared, items = prose(r, "en", 70), [prose(r, "en", 25) for _ in range(4)]
    for i in range(150):
        lang = r.choice(["en", "de"])
        parts = [prose(r, lang, r.randrange(5, 60)) for _ in range(r.randrange(1, 4))]
        if i % 15 == 3:
            parts.append(shared)
        if i % 25 == 4:
            parts[0] += " " + items[i // 25 % 4]
        rows.append([i, "\n".join(parts), lang, "abc"[i % 3 if i % 2 else 0], 0])
    rows += [[200, rows[10][1], "en", "a", 0], [201, rows[11][1] + " indeed", "en", None, 0], [202, "1234 !", "en", "b", 0], [203, None, "en", "b", None],
             [204, "", None, "b", 0], [205, rows[12][1].replace("\n", " \n "), "de", "b", 0]]
    rows = [(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s, _ in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_whole_pipeline(spark, corpus):
    folder, rows, items = corpus
    docs, reached = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        reached.append({r.doc_id: r for r in docs.collect()})
        docs.write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
    language, lines, near, clean, mix = reached
    assert set(language) == {k for k, t, *_ in rows if t and re.search("[a-z]", t)}
    wanted = dedup([(k, language[k].text) for k in language])
    assert {k: r.text for k, r in lines.items()} == {k: t for k, t in wanted.items() if t.strip() or t == language[k].text}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    prints = {k: simhash.fingerprint(r.text.encode()) for k, r in lines.items()}
    root = {k: k for k in prints}
    for _ in range(len(prints)):
        moved = {k: min(root[j] for j in prints if (prints[j] ^ prints[k]).bit_count() <= 2) for k in prints}
        if moved == root:
            break
        root = moved
    assert set(near) == {k for k in root if root[k] == k}
    keys = sorted(near)
    assert set(clean) == set(keys) - {keys[t] for t, _ in leaks(items, [near[k].text for k in keys])}
    want = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{folder}/decontamination.parquet")).collect()}
    counts = defaultdict(int)
    for r in docs.collect():
        counts[r.doc_id] += 1
    assert dict(counts) == {k: n for k, n in want.items() if n} and all(mix[k].text == clean[k].text for k in mix)
    run = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(run, key=str) == sorted((tuple(r) for r in docs.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_awkward_rows(spark, corpus, name):
    folder, stage = corpus[0], dict(corpus_pipeline.STAGES)[name]
    docs = frame(spark, awkward())
    got = stage(spark, docs, folder)
    assert got.columns[:len(docs.columns)] == docs.columns
    kept = {r.doc_id for r in got.collect()}
    if name == "language_id":
        assert kept.isdisjoint({2, 3, 4, 6, 10}) and {1, 5, 7, 8} <= kept
    elif name == "simhash":
        assert {1, 2, 5, 6, 7, 8, 9} <= kept and kept.isdisjoint({3, 4, 10})
    elif name != "mixing":
        assert got.count() == docs.count()
    assert stage(spark, frame(spark, []), folder).count() == 0


def test_stages():
    assert NAMES == ["language_id", "line_dedup", "simhash", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and os.path.dirname(corpus_pipeline.__file__) == os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert langid.SAMPLE and decontam.WINDOW


def test_one_of_each_group_of_near_copies_stays(spark):
    """Repeated rows, rows without an id and rows that share one: the least id stays, null last."""
    r = random.Random(3)
    a, b, c = (prose(r, "en", 300) for _ in range(3))
    rows = [(5, a, "en", "s", 1), (3, a, "en", "s", 1), (3, a, "de", "t", 2), (None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1),
            (7, c, "en", "s", 1), (7, c + " more", "en", "s", 1), (8, "", "en", "s", 0), (9, None, "en", "s", None)]
    kept = [(k.doc_id, k.text) for k in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, COLUMNS), "").collect()]
    assert sorted(kept[:], key=str) == sorted([(3, a), (None, b), (8, ""), *[(k, t) for k, t in kept if k == 7]], key=str)
    assert 1 <= sum(k == 7 for k, _ in kept) <= 2
