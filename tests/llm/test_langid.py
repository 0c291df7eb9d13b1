import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import langid
from helpers import LONG, awkward, frame

SAMPLES = {"en": "the cat and the dog were in the house with the ring ", "de": "der hund und die katze sind nicht im großen haus für ",
           "fr": "le chat et la souris étaient dans la maison où être "}


def corpus(n=240):
    rows = []
    for i in range(n):
        lang = sorted(SAMPLES)[i // 3 % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(words[(i * k + k) % len(words)] for k in range(1, 5 + i % 20)), lang, "s", 0, "x", 1, "p"))
    return rows


def ngrams(text):
    """Counts by slot, one n-gram at a time."""
    spaced = ""
    for c in text.lower():
        if c.isalpha():
            spaced += c
        elif spaced and spaced[-1] != " " :
            spaced += " "
    counts = np.zeros(langid.SLOTS, int)
    for order in langid.ORDERS:
        for i in range(len(spaced) - order + 1):
            counts[langid.slots_of(np.array([ord(c) for c in spaced[i:i + order]], np.uint32), order)[0]] += 1
    return counts


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_gram_counts_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in ("Über die 3 Brücken..ÉLE! ", "a", "ab 𝄞 naïve", "x1y2"):
        assert (langid.gram_counts(text) == ngrams(text)).all()
    assert langid.gram_counts("12 !") is None and langid.gram_counts("") is None and langid.gram_counts(None) is None


def test_held_out_accuracy(spark):
    docs = frame(spark, corpus())
    model = langid.train(docs, F.col("doc_id") % 3 != 1)
    assert model.classes == ["de", "en", "fr"] and 0 < model.temperature
    found = langid.identify(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in found if r.doc_id % 3 == 1) >= 0.95 * 80
    assert all(0 <= r.score <= 1 for r in found)


def test_document_frequencies_cover_all_rows(spark):
    docs = frame(spark, corpus(60) + awkward())
    n, seen = langid.document_frequencies(docs.repartition(5), "text")
    known = [c for c in (langid.gram_counts(r.text) for r in docs.collect()) if c is not None]
    assert n == len(known) and (seen == sum((c > 0).astype(int) for c in known)).all()


def test_awkward_rows(spark):
    docs = frame(spark, corpus() + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in awkward()])
    model = langid.train(docs, F.lit(True))
    found = langid.identify(docs, model, lang="LANG")  # takes the place of lang
    assert "lang" not in found.columns
    by = {r.doc_id: r for r in found.collect()}
    assert [by[k].LANG for k in (1002, 1003, 1004, 1006, 1010)] == ["und"] * 5 and by[1003].score == 0
    assert by[1005].text == LONG and by[1005].LANG in model.classes
    assert found.count() == docs.count()


def test_nothing_to_learn_from(spark):
    docs = frame(spark)
    model = langid.train(docs, F.lit(False))
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} == {"und"}
    empty = frame(spark, [])
    assert langid.identify(empty, langid.train(empty, F.lit(True))).count() == 0


def test_temperature_lowers_loss():
    r = np.random.default_rng(1)
    labels = r.integers(0, 3, 400)
    logits = r.normal(size=(400, 3)) + 0.8 * np.eye(3)[labels]
    t = langid.temperature(logits * 9, labels)
    loss = lambda t: -np.log(langid.softmax(logits * 9 / t)[np.arange(400), labels]).mean()
    assert t > 4 and loss(t) <= min(loss(t * 1.1), loss(t * 0.9), loss(1.0))
