"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, FTRL-trained, temperature-calibrated."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import hidden, shown

#: Hashed features, a power of two; n-gram lengths; code points taken at a time.
SLOTS, ORDERS, PIECE = 1 << 15, (1, 2, 3), 1 << 20
#: About so many labelled rows of each language train the model.
SAMPLE = 400
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def slots_of(codes: np.ndarray, order: int) -> np.ndarray:
    """Feature slots of the n-grams of ``order`` code points."""
    mixed = np.full(max(0, len(codes) - order + 1), order, np.uint32)
    for k in range(order):
        mixed = mixed * np.uint32(0x9E3779B1) + codes[k:len(codes) - order + 1 + k]
        mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - SLOTS.bit_length() + 1)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of a whole text, lower-cased, each run of other characters as one blank; None without letters."""
    counts, found = np.zeros(SLOTS, np.int64), False
    tail, was_letter = np.zeros(0, np.uint32), False  # what the next piece's first n-grams need of this one
    for start in range(0, len(text or ""), PIECE):
        codes = np.frombuffer(text[start:start + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = letters()[codes]
        found |= bool(alpha.any())
        keep = alpha | np.append(was_letter, alpha[:-1])
        spaced = np.append(tail, np.where(alpha, codes, np.uint32(32))[keep])
        for order in ORDERS:
            counts += np.bincount(slots_of(spaced[max(0, len(tail) - order + 1):], order), minlength=SLOTS)
        tail, was_letter = spaced[-(max(ORDERS) - 1):], alpha[-1]
    return counts if found else None


@dataclass
class Model:
    """Classes, inverse document frequencies, weights (a row per slot and one for the bias), temperature."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * self.idf[at]
        return at, values / max(np.sqrt(values @ values), 1e-12)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, values = self.features(counts)
        return values @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text)
        if counts is None or not self.classes:
            return UNKNOWN, 0.0
        odds = softmax(self.logits(counts) / self.temperature)
        best = int(odds.argmax())
        return self.classes[best], float(odds[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Rows with letters and, for each slot, rows that have it; counted over all rows, summed by slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SLOTS + 1, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                counts = gram_counts(value.as_py())
                if counts is not None:
                    seen[:SLOTS] += counts > 0
                    seen[SLOTS] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["slot", "n"])

    rows = docs.select(text).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(SLOTS + 1, np.int64)
    for row in rows:  # a row per slot at most
        seen[row["slot"]] = row["n"]
    return int(seen[SLOTS]), seen[:SLOTS]


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights by follow-the-regularised-leader with elastic net, over the examples in their order, ``epochs`` times."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))
    weigh = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for (at, values), label in zip(examples, labels):
            at, values = np.append(at, SLOTS), np.append(values, 1.0)
            w = weigh(z[at], n[at])
            error = softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    return weigh(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    low, high, cut = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from the rows where ``learn`` holds and the label is known.

    Inverse document frequencies come from all of these rows. Weights are fitted on a sample of about ``sample`` rows of each
    language, drawn by a hash of the key, and a fifth of it sets the temperature. Without any row the model knows no language.
    """
    labelled = docs.filter(learn & F.col(label).isNotNull()).select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label"))
    sizes = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
    classes = sorted(sizes)
    n, seen = document_frequencies(labelled, "text")
    model = Model(classes, (np.log((n + 1) / (seen + 1)) + 1).astype(np.float32), np.zeros((SLOTS + 1, len(classes))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(9), "key"), 11) / float(1 << 53)
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c in classes for x in (c, sample / sizes[c])]), F.col("label")), F.lit(0.0)) if classes else F.lit(0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for draw, value, name in zip(*(batch.column(k).to_pylist() for k in range(3))):
                counts = gram_counts(value)
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((draw, name, at.astype(np.int32), counts[at].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
                zip(*out) if out else [[]] * 4, [pa.float64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())])],
                ["draw", "label", "at", "n"])

    drawn = labelled.withColumn("draw", draw).filter(F.col("draw") < share).select("draw", "text", "label")
    rows = sorted(drawn.mapInArrow(count, "draw double, label string, at array<int>, n array<int>").collect(), key=lambda r: (r["draw"], r["label"]))
    if not rows:
        return Model([], model.idf, model.weights[:, :0])
    counts = []
    for row in rows:
        dense = np.zeros(SLOTS, np.int64)
        dense[row["at"]] = row["n"]
        counts.append(model.features(dense))
    labels = np.array([classes.index(row["label"]) for row in rows])
    held = np.arange(len(rows)) % 5 == 4
    model.weights = ftrl([x for x, h in zip(counts, held) if not h], labels[~held], len(classes))
    if held.any():
        logits = np.array([v @ model.weights[at] + model.weights[-1] for (at, v), h in zip(counts, held) if h])
        model.temperature = temperature(logits, labels[held])
    model.weights = model.weights.astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of every whole text and the calibrated probability of it.

    A text that is null or has no letters gets ``und`` with score 0, as does every text if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # a row of weights per slot at any size of docs

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    inner, names = hidden(docs)
    found = inner.withColumn("_found", predict.asNondeterministic()(names[text]))
    return shown(found, names, {lang: F.col("_found.lang"), score: F.col("_found.score")})
