"""Small tables with the awkward cases: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

import random

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _salt string, repetition int, predicted string"


def awkward(extra=()):
    rows = [
        (1, "One two three four.\nFive six.", "en", "a", 29, "x", 1, "p"), (2, "", "en", "b", 0, None, 2, "p"), (3, None, "en", "a", None, "x", 3, None),
        (None, "text without a key", "en", "a", 18, "x", 4, "p"), (None, "text without a key", None, None, 18, "x", 4, "p"),
        (4, " \t\n ", None, None, 4, "x", 5, "p"), (5, LONG, "en", "c", len(LONG), "x", 6, "p"), (6, "12 !", "de", None, 4, "x", 7, "p"),
        (7, "tie", "en", "a", 3, "x", 8, "p"), (7, "tie", "en", "a", 3, "x", 8, "p"), (8, "Größe über alles, 𝄞 naïve", "de", "b", 25, "x", 9, "p"),
        (9, "a b a\u0085b", "fr", "b", 7, "x", 9, "p"), (10, "\n\n\n", "en", "a", 3, "x", 9, "p")]
    return rows + [tuple(r) for r in extra]


def frame(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(awkward() if rows is None else rows, schema)


def prose(seed, words, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))
