"""Toxicity: window lengths under a zstandard dictionary of toxic text against one of ordinary text, calibrated."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import discard, hidden, shown, stored

#: A window is a word of three letters or more, in lower case, between blanks, written so often that a short match shows.
WORDS, COPIES = re.compile(r"[^\W\d_]{3,}"), 4
#: Dictionary bytes; windows that train each dictionary at most (a bounded part of what the labelled rows hold).
TOXIC_BYTES, ORDINARY_BYTES, TOXIC_WINDOWS, ORDINARY_WINDOWS = 4096, 65536, 4000, 40_000
#: A window trains the toxic dictionary if in so many toxic texts, and so many times likelier there than in ordinary ones.
LEAST_TEXTS, LEAST_ODDS = 3, 8.0
#: Labelled rows (about) that set the last step, features to probability; log-likelihood ratio from which a window counts.
SAMPLE, COUNTS_FROM = 20_000, 2.0
#: Words remembered by a task, or counted before they are handed on.
REMEMBERED = 200_000


def words_of(text: str | None) -> set[str]:
    """The distinct windows of a whole text."""
    return set(WORDS.findall((text or "").lower()))


def _trained(size: int, samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; what is too little to train on is taken as content."""
    try:
        return zstandard.train_dictionary(size, samples, k=16 if size < 16384 else 32, d=6)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _lengths(dictionary: bytes) -> Callable[[bytes], int]:
    held = zstandard.ZstdCompressionDict(dictionary)
    options = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=12, chain_log=12, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    compress = zstandard.ZstdCompressor(dict_data=held, compression_params=options).compress
    return lambda window: len(compress(window))


@dataclass
class Model:
    """Two dictionaries, the log-likelihood ratio of each (length, compressed lengths), and weights of a text's features."""

    ordinary: bytes = b""
    toxic: bytes = b""
    ratios: dict[tuple[int, int, int], float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0, 0, 0]))

    def measure(self) -> Callable[[str], tuple[int, int, int]]:
        """Of a window: its length, and its compressed lengths under the ordinary and the toxic dictionary."""
        ordinary, toxic = _lengths(self.ordinary), _lengths(self.toxic)

        def cell(word: str) -> tuple[int, int, int]:
            window = f" {word} ".encode()
            return min(len(window), 64), ordinary(window * COPIES), toxic(window * COPIES)

        return cell

    def scorer(self) -> Callable[[str | None], tuple[float, float, int]]:
        """Of a text: sum and largest of the ratios that count, and how many distinct windows it has."""
        if not self.ratios:
            return lambda text: (0.0, 0.0, len(words_of(text)))
        cell, known = self.measure(), {}

        def score(text: str | None) -> tuple[float, float, int]:
            if len(known) > REMEMBERED:
                known.clear()
            words, found = words_of(text), []
            for word in words:
                ratio = known.get(word)
                if ratio is None:
                    ratio = known[word] = self.ratios.get(cell(word), 0.0)
                if ratio >= COUNTS_FROM:
                    found.append(ratio)
            found.sort()
            return float(sum(found)), float(found[-1]) if found else 0.0, len(words)

        return score


def features(sums: np.ndarray, largest: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One row per text: 1, the sum (damped), the largest ratio, the number of windows (damped)."""
    return np.stack([np.ones(len(sums)), np.sqrt(np.asarray(sums, float)), np.asarray(largest, float), np.log1p(np.asarray(words, float))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def window_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): in how many texts of each label (columns text, label) a window occurs, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[dict, dict] = ({}, {})

        def flush() -> pa.RecordBatch:
            every = sorted(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([
                pa.array(every, pa.string()), pa.array([seen[1].get(w, 0) for w in every], pa.int64()),
                pa.array([seen[0].get(w, 0) for w in every], pa.int64())], ["word", "toxic", "ordinary"])
            seen[0].clear(), seen[1].clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts = seen[label]
                for word in words_of(text.as_py()):
                    counts[word] = counts.get(word, 0) + 1
                if len(seen[0]) + len(seen[1]) > REMEMBERED:
                    yield flush()
        yield flush()

    counted = labelled.select("text", "label").mapInArrow(count, "word string, toxic long, ordinary long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from rows with label 1 (toxic) or 0; rows with a null label are left out.

    How many texts of each label hold a window is counted over all rows. The toxic dictionary is trained on windows frequent
    and typical in toxic texts, the ordinary one on the most frequent ones of ordinary texts. A window's three lengths make a
    cell; each cell's log-likelihood ratio comes from all windows of all rows. A text's ratios become a probability by a
    logistic regression on about ``sample`` rows. Without rows of both labels every score is about 0.
    """
    rows = labelled.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model()
    counts = stored(window_counts(rows), "windows")
    odds = (F.col("toxic") / sizes[1]) / ((F.col("ordinary") + 1) / sizes[0])
    typical = counts.filter((F.col("toxic") >= LEAST_TEXTS) & (odds > LEAST_ODDS)).orderBy(F.desc("toxic"), "word").limit(TOXIC_WINDOWS).collect()
    common = counts.filter("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(ORDINARY_WINDOWS).collect()
    if not typical or not common:
        return Model()
    window = lambda word: f" {word} ".encode()
    share = max(1, common[0]["ordinary"] // 100)
    model = Model(
        _trained(ORDINARY_BYTES, [window(r["word"]) * min(8, 1 + r["ordinary"] // share) for r in common]).as_bytes(),
        _trained(TOXIC_BYTES, [window(r["word"]) * min(r["toxic"], 200) for r in typical]).as_bytes())

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = model.measure()
        for batch in batches:
            sizes = np.array([cell(w) for w in batch.column(0).to_pylist()], np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(sizes[:, k]) for k in range(3)), batch.column(1), batch.column(2)], ["n", "o", "t", "toxic", "ordinary"])

    held = counts.mapInArrow(cells, "n int, o int, t int, toxic long, ordinary long").groupBy("n", "o", "t").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).collect()  # three short lengths: a few thousand cells
    discard(counts)
    toxic, ordinary = (sum(r[c] for r in held) for c in ("toxic", "ordinary"))
    prior = 1.0  # a window more in each cell keeps rare cells near no evidence
    model.ratios = {
        (r["n"], r["o"], r["t"]): float(np.log((r["toxic"] + prior * toxic / (toxic + ordinary)) / toxic) - np.log(
            (r["ordinary"] + prior * ordinary / (toxic + ordinary)) / ordinary)) for r in held}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(5), "key"), 11) / float(1 << 53)
    few = rows.filter(draw < sample / (sizes[0] + sizes[1])).select("text", "label")
    x = np.array([(*r["f"], r["label"]) for r in few.select(_score(model, few.sparkSession)("text").alias("f"), "label").collect()], float).reshape(-1, 4)
    if 0 < x[:, 3].sum() < len(x):
        model.weights = fit_logistic(features(x[:, 0], x[:, 1], x[:, 2]), x[:, 3])
    return model


def _score(model: Model, spark) -> Callable:
    shared = spark.sparkContext.broadcast(tuple(vars(model).values()))  # dictionaries and cells: a few hundred KB at any size of the corpus

    @F.arrow_udf("struct<sums:double,largest:double,words:int>")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = Model(*shared.value).scorer()
        for batch in texts:
            found = [of(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int32()))], ["sums", "largest", "words"])

    return score


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that each whole text is toxic; null and empty texts get that of a text without windows."""
    w = [float(x) for x in model.weights]
    odds = F.lit(w[0]) + w[1] * F.sqrt("_f.sums") + w[2] * F.col("_f.largest") + w[3] * F.log1p("_f.words")
    inner, names = hidden(docs)
    scored = inner.withColumn("_f", _score(model, docs.sparkSession).asNondeterministic()(names[text]))
    return shown(scored, names, {out: 1 / (1 + F.exp(-odds))})
