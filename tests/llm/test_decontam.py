import random

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import decontam
from helpers import LONG, awkward, frame

ITEM = "item_id long, text string, doc_id long"


def fold(text):
    out = ""
    for c in text:
        if ord(c) < 128:
            c = c.lower() if c.isalnum() else " "
        elif c.isupper() and len(c.lower()) == 1:
            c = c.lower()
        out += "" if c == " " and (not out or out.endswith(" ")) else c
    return out


def sellers(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row.min()


def brute(items, texts):
    """Every window of every item against every text; short items as whole words."""
    out = {}
    for i, item in enumerate(fold(t).rstrip(" ") for t in items):
        if not item:
            continue
        size = min(len(item), decontam.WINDOW)
        for t, text in enumerate(map(fold, texts)):
            if len(item) < decontam.LEAST:
                if f" {item} " in f" {text} ":
                    out[t, i] = 0
                continue
            least = min(sellers(item[s:s + size], text) for s in range(len(item) - size + 1))
            if least <= size // decontam.EVERY:
                out[t, i] = int(least)
    return out


def words(r, n):
    return " ".join("".join(r.choice("an er ti on the re is éd".split()) for _ in range(r.randrange(1, 4))) for _ in range(n))


def spoiled(r, text, rate):
    return "".join(r.choice(["", "q", c + "z"]) if r.random() < rate else c for c in text)


def test_against_brute_force():
    r = random.Random(6)
    items = [words(r, n) for n in (2, 4, 6, 9, 14, 20, 30, 45)] + ["the the the the the the the the the the the the the the", "É" * 40]
    texts = []
    for n in range(90):
        item = r.choice(items)
        cut = r.randrange(len(item) // 2 + 1)
        part = spoiled(r, r.choice([item, item.upper(), item[cut:], item.replace(" ", " !\n ")]), r.choice([0, .02, .05, .08]))
        texts.append(r.choice(["", words(r, 12) + " "]) + part + r.choice(["", " " + words(r, 9)]))
    texts += ["", "the " * 300, "x"]
    got = decontam.leaks(decontam.Items.of(list(range(len(items))), items), pa.array(texts))
    found = {(int(t), int(i)): int(e) for t, i, _, _, e in zip(*got)}
    want = brute(items, texts)
    assert set(found) <= set(want)  # nothing is reported that does not align
    # the lemma counts q-grams, so it misses nothing where a window has as many q-grams as it needs
    assert set(want) == set(found), set(want) - set(found)
    assert all(found[k] >= want[k] for k in want)


def letters(r, script, n):
    return "".join(r.choice(script) for _ in range(n))


@pytest.mark.parametrize("script", ["etaoin shrdlu", "оеаинт срвл", "日本語の文章 漢字"])
def test_items_of_every_length_in_three_scripts(script):
    """Items of 1 to 140 characters, copied with as many edits as they may have, one fewer and one more."""
    r = random.Random(len(script))
    items = [letters(r, script, n) for n in (1, 2, 5, 9, 15, 16, 23, 24, 25, 31, 32, 33, 34, 35, 36, 47, 48, 63, 64, 65, 90, 140)]
    texts = []
    for item in items:
        for n in range(max(1, min(len(item), 64) // 16) + 2):
            spoilt = list(item)
            for k in range(n):  # edits spread evenly hide most q-grams
                at = (2 * k + 1) * len(item) // (2 * n)
                spoilt[at] = r.choice(["ж" if script[0] == "e" else "x", ""]) if spoilt[at] != " " else "q"
            texts.append(r.choice(["", letters(r, script, 20) + " "]) + "".join(spoilt) + r.choice(["", " " + letters(r, script, 9)]))
    got = decontam.leaks(decontam.Items.of(list(range(len(items))), items), pa.array(texts))
    want = brute(items, texts)
    found = {(int(t), int(i)): int(e) for t, i, _, _, e in zip(*got)}
    assert set(found) == set(want) and all(found[k] >= want[k] for k in want)


def test_short_items_are_whole_words():
    items = decontam.Items.of([7, 8, 9], ["Capital of France", "ring", "ring"])
    texts = ["So the capital of France is Paris.", "the capital of Frances", "a ring", "bringing", "Ring!", None, ""]
    row, item, start, end, edits = decontam.leaks(items, pa.array(texts))
    assert [(t, items.ids[i], texts[t][a:b]) for t, i, a, b in zip(row, item, start, end)] == [
        (0, [7], "capital of France"), (2, [8, 9], "ring"), (4, [8, 9], "Ring")] and not edits.any()


def test_places_are_characters():
    item = "Ünïcödé passage that is long enough to be looked for in texts, surely so"
    text = "ééé 𝄞 " + item + " end"
    _, _, start, end, edits = decontam.leaks(decontam.Items.of([1], [item]), pa.array(["zz", None, text]))
    assert edits[0] == 0 and text[start[0]:end[0]] in item and end[0] - start[0] >= 50


@pytest.mark.parametrize("piece", [64, 1000, 1 << 20])
def test_pieces_change_nothing(monkeypatch, piece):
    r = random.Random(8)
    items = [words(r, 15) for _ in range(5)]
    texts = pa.array([words(r, 30) + " " + items[n % 5] + " " + words(r, n) if n % 3 else None for n in range(40)])
    whole = [x.tolist() for x in decontam.leaks(decontam.Items.of(list(range(5)), items), texts)]
    monkeypatch.setattr(decontam, "PIECE", piece)
    monkeypatch.setattr(decontam, "HITS", 64)
    assert [x.tolist() for x in decontam.leaks(decontam.Items.of(list(range(5)), items), texts)] == whole


def test_awkward_rows(spark):
    r = random.Random(9)
    items = [(1, words(r, 20), 5), (None, words(r, 20), 5), (2, None, 5), (3, "", 5), (4, "short", 5), (5, items_text := words(r, 25), 5), (6, items_text, 5)]
    leaks = [(50, "x " + items[0][1], "en", "a", 0, "x", 1, "p"), (51, LONG + items_text, "en", "a", 0, "x", 1, "p"), (None, items[1][1], "en", "a", 0, "x", 1, "p")]
    docs, benchmark = frame(spark, awkward(leaks)), spark.createDataFrame(items, ITEM)
    for block in (1 << 20, 100):
        got = decontam.find_leaks(docs, benchmark, block_bytes=block)
        assert got.columns == ["doc_id", "item_id", "start", "end", "edits"]
        assert {(x.doc_id, x.item_id) for x in got.collect()} == {(50, 1), (51, 5), (51, 6), (None, None)}
        clean = decontam.drop_contaminated(docs, benchmark, block_bytes=block)
        assert clean.columns == docs.columns and clean.count() == docs.count() - 3
    assert decontam.find_leaks(frame(spark, []), benchmark).count() == 0
    assert decontam.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()
