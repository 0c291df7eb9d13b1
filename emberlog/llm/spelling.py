"""Spelling variants: words one error apart, found with a bidirectional index, and the common form each belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import discard, stored, whole_groups
from emberlog.llm.fmindex import Index, one_error
from emberlog.operators.joins import attach

#: Rows and letters that are indexed together, but for the rest of a group; a larger group is cut by more of its words' letters.
ROWS, LETTERS, CROWD = 50_000, 1 << 20, 4096
#: What a word is made of.
RUN = "[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(id, word): a row for every run of letters of ``least`` or more in every whole text, A to Z lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    return docs.select(F.col(key).alias("id"), F.explode(found).alias("word")).withColumn("word", F.translate("word", CAPITALS, SMALL))


def vocabulary(words: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """(word, n): the words of ``least`` letters or more that occur ``times`` or more often; null words do not count."""
    return words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows meet on all letters outside of the places where the error may be; a hash of these only says where to meet."""
    outside = F.xxhash64("size", "first", "last", F.expr("left(word, first)"), F.expr("right(word, size - last)"))
    return rows.withColumn("key", outside)


def _seeds(words: DataFrame, crowd: int) -> DataFrame:
    """(word, n, size, first, last, key): a row for every size of the longer word of a pair, and every part that may hold the error.

    Two words one error apart are equal in the left or the right half of the longer one. Where more than ``crowd`` words have a
    half in common, the other half is halved in turn, and so on: the rest of the word narrows the group, so a group of any size
    ends in small ones, and no word is compared with all of them.
    """
    length = F.char_length("word")
    rows = words.withColumn("size", F.explode(F.array(length, length + 1)))
    half = F.floor(F.col("size") / 2).cast("int")
    part = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    rows = rows.withColumn("_part", F.explode(F.array(part(half, F.col("size")), part(F.lit(0), half)))).select("word", "n", "size", "_part.*")
    rows, ready = stored(_keyed(rows), "spelling_seeds"), None
    while True:
        crowded = stored(rows.filter("last - first > 1").groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > crowd), "spelling_crowded")
        if crowded.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        marked = attach(rows, crowded, ["key"], "left")
        split = F.col("_rows").isNotNull() & (F.col("last") - F.col("first") > 1)
        calm = marked.filter(~split).drop("_rows")
        ready = calm if ready is None else ready.unionByName(calm)
        middle = F.floor((F.col("first") + F.col("last")) / 2)
        halves = marked.filter(split).withColumn("_part", F.explode(F.array(part(F.col("first"), middle), part(middle, F.col("last")))))
        rows = stored(_keyed(halves.select("word", "n", "size", "_part.*")), "spelling_seeds")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, best): for words (word, n) that have others one inserted, deleted or replaced character away.

    ``best`` is the one with the largest n, the first in code-point order of several, as a struct (n, word).
    """
    seeds = _seeds(words, crowd)
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seeds.count() // ROWS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, letters = [], 0, 0
        for table, at in whole_groups(batches, ["key"]):
            alone = np.repeat(np.diff(at) == 1, np.diff(at))  # nothing shares the half of these
            if alone.all():
                continue
            held.append(table.filter(pa.array(~alone)))
            rows, letters = rows + len(held[-1]), letters + int(pa.compute.sum(held[-1].column("size")).as_py())
            if rows >= ROWS or letters >= LETTERS:
                yield _search(pa.concat_tables(held))
                held, rows, letters = [], 0, 0
        if held:
            yield _search(pa.concat_tables(held))

    dealt = seeds.repartition(parts, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(search, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_first"))
    return near.select("word", "n_near", F.struct((-F.col("_first.n")).alias("n"), F.col("_first.word").alias("word")).alias("best"))


def _search(rows: pa.Table) -> pa.RecordBatch:
    """The rows' words indexed, and each row's word looked up with one error in the part that the row names."""
    coded = rows.column("word").combine_chunks().dictionary_encode()
    words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    size, first, last = (rows.column(c).to_numpy().astype(np.int64) for c in ("size", "first", "last"))
    n = np.zeros(len(words), np.int64)
    n[word] = rows.column("n").to_numpy()
    index = Index(words)
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    longer, count, best = size > index.lengths[word], np.zeros(len(words), np.int64), np.full(len(words), len(words))
    right = first >= size // 2
    for rows_, way, start, end in ((right, index, first, last), (~right, index.reverse(), size - last, size - first)):
        mine = np.flatnonzero(rows_)
        for which, other in one_error(way, word[mine], longer[mine], start[mine], end[mine]):
            who = word[mine[which]]
            np.add.at(count, who, 1)
            np.minimum.at(best, who, rank[other])
    some = np.flatnonzero(count)
    chosen = np.array(order, np.int64)[best[some]]
    pick = coded.dictionary.take
    return pa.RecordBatch.from_arrays([pick(pa.array(some)), pa.array(count[some]), pa.array(n[chosen]), pick(pa.array(chosen))],
                                      ["word", "n_near", "best_n", "best"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms from each word on; every round follows twice as many."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling_roots")
        discard(now)
        now = after.drop("_moved")
        if after.filter("_moved").isEmpty():
            return now


def group_variants(words: DataFrame, ratio: int = 10, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words.

    A word's form is its near word (one inserted, deleted or replaced character) of largest n, the first in code-point order of
    several, if that n is ``ratio`` times the word's or more, else null; ``root`` is where the forms from a word on end, the word
    itself if it has none. With a ``ratio`` above 1 n grows along the way, so forms never go in circles. Null words and words
    without a letter have no near words; an empty vocabulary gives an empty table.
    """
    if ratio <= 1:
        raise ValueError("a form is more common than its word")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "spelling_words")
    near = stored(near_words(words.filter(F.col("word").isNotNull() & (F.col("word") != "")), crowd), "spelling_near")
    common = lambda c: F.when(F.col("best.n") >= ratio * F.col("n"), F.col(c))
    formed = words.join(near, "word", "left").select(
        "word", common("best.word").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), common("best.n").alias("form_n"))
    roots = _roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def without_letter(word: Column, place: Column) -> Column:
    """A word without the character at ``place``, from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word)))
