import random

import numpy as np

from emberlog.llm import toxicity
from helpers import LONG, awkward, frame

BAD = ["wretch", "villain", "scoundrel", "dimwit"]


def corpus(spark, n=900):
    r, rows = random.Random(3), []
    syllables = "an er ti on the re is ed ou le".split()
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(20, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = toxicity.train(docs.filter("doc_id % 5 <> 0"))
    assert model.toxic != model.ordinary and model.ratios
    held = [(r.toxic, r.score) for r in toxicity.score(docs.filter("doc_id % 5 = 0"), model).collect()]
    assert np.mean([(s >= 0.5) == bool(t) for t, s in held]) >= 0.93


def test_window_counts_cover_all_rows(spark):
    docs = corpus(spark, 120).withColumnRenamed("toxic", "label")
    want = {}
    for r in docs.collect():
        for w in toxicity.words_of(r.text):
            want.setdefault(w, [0, 0])[r.label] += 1
    got = {r.word: [r.ordinary, r.toxic] for r in toxicity.window_counts(docs.repartition(4)).collect()}
    assert got == want


def test_awkward_rows(spark):
    labelled = corpus(spark)
    model = toxicity.train(labelled.unionByName(spark.createDataFrame(
        [(None, None, 1), (5000, "", 0), (5001, LONG, 0), (5002, "x", None)], labelled.schema)))
    docs = frame(spark, awkward([(40, None, None, None, None, None, None, None)]))
    got = toxicity.score(docs, model, out="PREDICTED")
    assert "predicted" not in got.columns and got.count() == docs.count()
    assert all(0 <= r.PREDICTED <= 1 for r in got.collect())
    by = {r.doc_id: r.PREDICTED for r in got.collect()}
    assert by[2] == by[3] == by[4] < 0.5


def test_labels_of_one_kind_or_none(spark):
    for part in (corpus(spark, 60).filter("toxic = 0"), corpus(spark, 60).filter("toxic > 1")):
        model = toxicity.train(part)
        assert all(r.score < 0.01 for r in toxicity.score(part.limit(5), model).collect())
    assert toxicity.score(frame(spark, []), toxicity.Model()).count() == 0
