"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import free_name, hidden, shown, stored, word_count
from emberlog.operators.joins import attach

#: Hex digits of a draw that name a bucket at each of the two levels of the threshold search: 4096 buckets a level.
DIGITS = 3


def fill_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Targets for ``sources`` (source, source_size; one row each): adds weight and target.

    Weights are dealt to the sources in code-point order, null last, and start over when used up. ``share`` of all sizes is
    split by weight; a source stops at ``max_epochs`` times its size and its excess goes to the others by weight, until none
    is above. With sources in the order in which they fill up, the level (target per weight) is the largest of "what is left /
    weight that is left" over the order, so no loop is needed. The windows see one row per source.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sources.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    ).withColumn("_cap", F.col("source_size") * max_epochs)
    filling = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filling), F.lit(0))
    left = F.sum("source_size").over(everything) * float(share) - before("_cap")
    level = weighted.withColumn("_level", left / (F.sum("weight").over(everything) - before("weight")))
    return level.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.max("_level").over(everything))).drop(
        "_cap", "_level")


def _boundary(buckets: DataFrame, wanted: DataFrame, out: str) -> DataFrame:
    """The bucket of each source in which the running size passes ``_rest``; ``_rest`` becomes what is left for that bucket.

    ``buckets`` has one row per source and bucket, at most 4096 a source; a source whose buckets all fit gets a null bucket.
    """
    lists = buckets.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_bucket", "_size"))).alias("_list"))
    found = F.aggregate(
        "_list", F.struct(F.col("_rest").alias("rest"), F.lit(None).cast("string").alias("at")),
        lambda a, x: F.when(a["at"].isNotNull() | (x["_size"] > a["rest"]), F.struct(a["rest"].alias("rest"), F.coalesce(a["at"], x["_bucket"]).alias("at")))
        .otherwise(F.struct((a["rest"] - x["_size"]).alias("rest"), a["at"].alias("at"))))
    joined = wanted.join(lists, wanted["source"].eqNullSafe(lists["source"]), "left").drop(lists["source"])
    return joined.withColumn("_found", F.when(F.col("_list").isNotNull(), found)).withColumn(
        "_rest", F.coalesce("_found.rest", "_rest")).withColumn(out, F.col("_found.at")).drop("_found", "_list")


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join a per-source table to rows by source, null matching null; broadcast if small, else salted."""
    known = lambda d: d.withColumn("_known", F.col("source").isNotNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    return attach(known(rows), known(per_source).drop("source"), ["_known", "_source"], "left").drop("_known", "_source")


def _draw(docs_key: str, text: str, seed: int) -> Column:
    """MD5 of seed and key; rows without a key draw by their text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(docs_key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))))


def _limits(rows: DataFrame, weights: tuple[float, ...], max_epochs: int, share: float) -> DataFrame:
    """Per source of ``rows`` (source, size, draw): source_size, target, whole repetitions, and the draws that get one more."""
    sources = fill_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    wanted = stored(sources.withColumn("_whole", whole.cast("long")).withColumn(
        "_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "targets")
    bucket = lambda level: F.substring("draw", 1 + level * DIGITS, DIGITS)
    summed = lambda d, level: d.groupBy("source", bucket(level).alias("_bucket")).agg(F.sum("size").alias("_size"))
    first = stored(_boundary(summed(rows, 0), wanted, "_at0"), "level-1")
    inside = _with_source(rows, first.select("source", "_at0")).filter(bucket(0) == F.col("_at0"))
    second = stored(_boundary(summed(inside.select("source", "size", "draw"), 1), first, "_at1"), "level-2")
    last = _with_source(rows, second.select("source", "_at0", "_at1", "_rest")).filter(
        (bucket(0) == F.col("_at0")) & (bucket(1) == F.col("_at1")))
    draws = last.groupBy("source", "draw").agg(F.sum("size").alias("_size"), F.max("_rest").alias("_rest"))
    ordered = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.sum("_size").over(ordered), F.lit(0)) + F.col("_size") / 2 <= F.col("_rest")
    within = draws.withColumn("_fits", fits).filter("_fits").groupBy("source").agg(F.max("draw").alias("_last"))
    # all draws below the bucket found are taken ("g" follows every digit); so are those inside it that fit
    below = F.when(F.col("_at0").isNull(), F.lit("g")).otherwise(F.concat("_at0", F.coalesce("_at1", F.lit("g"))))
    limits = second.join(within, second["source"].eqNullSafe(within["source"]), "left").drop(within["source"])
    return stored(limits.select("source", "source_size", "target", "_whole", below.alias("_below"), "_last"), "limits")


def _copies(draw: Column, max_epochs: int) -> Column:
    more = (draw < F.col("_below")) | F.coalesce(draw <= F.col("_last"), F.lit(False))
    return F.least(F.col("_whole") + F.when(more & (F.col("target") > 0), 1).otherwise(0), F.lit(max_epochs)).cast("long")


def _sized(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    return stored(docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        _draw(key, text, seed).alias("draw")), "sizes")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3),
        max_epochs: int = 3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """How often each document is taken: key, source, size, source_size, target, copies, taken (= copies x size).

    A source is taken target / source_size times: whole repetitions of all its documents, and one more of those whose draw, an
    MD5 of seed and key, is at most a threshold. The threshold is the draw at which the running size comes nearest the rest of
    the target, so a source misses its target by half a document at most. It is searched by two levels of 4096 buckets of the
    draw, summed before they are shuffled; only the last bucket's draws are put in order.

    Nulls: a null text has size 0; null sources are one source; rows without a key draw by their text. Rows with the same key
    and source share their draw, and all are taken alike. A source without words, and an empty table, gets target 0.
    """
    rows = _sized(docs, key, source, text, seed)
    final = _with_source(rows, _limits(rows, weights, max_epochs, share))
    copies = _copies(F.col("draw"), max_epochs)
    return final.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (1, 2, 3),
         max_epochs: int = 3, share: float = 1.0, seed: int = 42) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, numbered by ``repetition`` from 1.

    Only the limits of each source are joined to the documents, so their texts are not moved.
    """
    limits = _limits(_sized(docs, key, source, text, seed), weights, max_epochs, share)
    inner, names = hidden(docs)
    inner = inner.withColumn("source", F.col(names[source]).cast("string"))
    copies = _copies(_draw(names[key], names[text], seed), max_epochs)
    taken = _with_source(inner, limits).withColumn("_copies", copies.cast("int")).filter("_copies > 0")
    repeated = taken.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return shown(repeated, names, {free_name(docs, "repetition"): F.col("_n")})
