"""Searches that go on over micro-batches: what each needs of the past is a small table of sums, not the lines themselves.

A batch of lines is searched together with the lines within the reach of its windows. What spans more time than that is
merged with rows kept per subject: runs are joined with the open run before them, counts are added up, gaps are summed. A batch
writes only the rows that it changed, into a folder named by its id; every few batches the table is written whole, so a reader
opens a bounded number of folders, and a batch run again replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators import detectors as det
from emberlog.operators.parse import parse_corpus
from emberlog.operators.slices import DAY, gap_sums
from emberlog.schema import MAX_AFFECTED_LINES, SEVERITIES
from emberlog.session import materialize
from emberlog.sources.alert_tables import WATCH, folder, write_batch, write_ioc_delta
from emberlog.sources.lines import number_lines

#: How a search's findings go on: bounded by its windows; counted over all time; the highest over all time; runs of moments
#: less than ``reach`` apart; gaps between moments.
BOUNDED, TOTAL, PEAK, RUN, GAPS = "bounded", "total", "peak", "run", "gaps"
#: Every so many batches the whole table is written.
WHOLE = 16
#: Lines may come so many seconds late and still find the run that they belong to.
LATE = DAY
_SPANS = -1

STATE = ("search int, category string, severity string, subject string, slot bigint, first_sec bigint, last_sec bigint, n bigint, "
         "s1 decimal(38,0), s2 decimal(38,0), lines array<string>, file string, format string")


class Search(NamedTuple):
    """One search of a watch.

    ``find`` takes tagged lines and gives findings (for GAPS: takes gap sums). ``reach``: seconds of earlier lines its windows
    see. ``slot``: findings are counted by windows of so many seconds. ``keep``: condition on the findings as merged.
    """

    find: Callable[[DataFrame], DataFrame]
    carry: str
    reach: int = 0
    slot: int = 0
    keep: str | None = None


#: The searches of ``detect_all`` whose findings can go on; a habit or a period over many days is left to batch jobs.
SEARCHES = (
    Search(det.brute_force, RUN, 90),
    Search(det.failure_bands, PEAK, 90, keep="severity <> 'HIGH'"),
    Search(det.sliding_stuffing, RUN, 3600),
    Search(det.sliding_scan, RUN, 3600),
    Search(det.success_after_failures, BOUNDED, 3600),
    Search(det.request_attacks, TOTAL),
    Search(det.clears, TOTAL),
    Search(det.privilege_escalation, TOTAL),
    Search(det.account_change, TOTAL),
    Search(lambda lines: det.exfiltration(lines, min_bytes=0), TOTAL, slot=DAY, keep=f"n >= {10**9}"),
    Search(det.regular_gaps, GAPS),
)


def search_all(parsed: DataFrame, searches: Sequence[Search] = SEARCHES) -> DataFrame:
    """What the searches find in a whole log at once."""
    def found(s: Search) -> DataFrame:
        rows = s.find(gap_sums(det.seconds_of_sources(parsed), ["source_ip"]) if s.carry == GAPS else parsed)
        return rows.filter(s.keep) if s.keep else rows

    return reduce(DataFrame.unionByName, map(found, searches))


# --- the kept table ---------------------------------------------------------------------


def read_state(spark: SparkSession, out: str, batch_id: int, feed: str = WATCH) -> DataFrame:
    """The table as it stood before ``batch_id``: the newest row of each key since it was last written whole."""
    first = max(0, batch_id - 1) // WHOLE * WHOLE
    every = [spark.read.schema(STATE).parquet(folder(out, "state", b, feed)).withColumn("_batch", F.lit(b)) for b in range(first, batch_id)]
    if not every:
        return spark.createDataFrame([], STATE)
    # a run is known by where it began, any other row by its subject and slot
    newest = Window.partitionBy("search", "category", "subject", "slot").orderBy(F.col("_batch").desc())
    return reduce(DataFrame.unionByName, every).withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "_batch")


def _write_state(changed: DataFrame, state: DataFrame, out: str, batch_id: int, feed: str, now: int | None, searches: Sequence[Search]) -> None:
    rows = changed
    if batch_id % WHOLE == 0:
        key = ["search", "category", "subject", "slot"]
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key])
        rest = state.alias("a").join(changed.alias("b"), same, "left_anti")
        if now is not None:  # what no later line can reach any more is left out
            longest = max(s.reach for s in searches)
            runs = [i for i, s in enumerate(searches) if s.carry == RUN or s.slot] + [_SPANS]
            rest = rest.filter(~F.col("search").isin(runs) | (F.col("last_sec") >= now - longest - max([LATE, *(s.slot for s in searches)])))
        rows = changed.unionByName(rest)
    rows.write.mode("overwrite").parquet(folder(out, "state", batch_id, feed))


def _worse(severity: Column) -> Column:
    return F.element_at(F.lit(SEVERITIES), F.min(F.array_position(F.lit(SEVERITIES), severity)).cast("int"))


# --- a batch ----------------------------------------------------------------------------


def _merged(parts: DataFrame, known: DataFrame, searches: Sequence[Search]) -> DataFrame:
    """The batch's findings joined with the kept rows of their subjects, in the layout of the table, with column ``joined``."""
    by = lambda *kinds: [i for i, s in enumerate(searches) if s.carry in kinds]
    rows = parts.withColumn("_new", F.lit(1)).unionByName(known.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    old = lambda c: F.max_by(c, F.struct(1 - F.col("_new"), -F.col("first_sec"))).alias(c)  # noqa: E731  the earliest kept row's
    other = [_worse(F.col("severity")).alias("severity"), old("lines"), old("file"), old("format"), F.min("_new").alias("_all_new"), F.max("_new").alias("_any_new")]
    common = [F.min("first_sec").alias("first_sec"), F.max("last_sec").alias("last_sec"), *other]
    counted = rows.filter(F.col("search").isin(by(TOTAL))).groupBy("search", "category", "subject", "slot").agg(F.sum("n").alias("n"), *common)
    highest = rows.filter(F.col("search").isin(by(PEAK))).groupBy("search", "category", "subject", "slot").agg(F.max("n").alias("n"), *common)
    reach = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(searches) for x in (i, s.reach)]), F.col("search"))
    order = Window.partitionBy("search", "category", "subject").orderBy("first_sec", "last_sec")
    before = F.max("last_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.filter(F.col("search").isin(by(RUN)))
    runs = runs.withColumn("_open", F.when(F.col("first_sec") - before < reach, 0).otherwise(1)).withColumn(
        "_run", F.sum("_open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = runs.groupBy("search", "category", "subject", "_run").agg(F.max("n").alias("n"), *common).drop("_run").withColumn("slot", F.col("first_sec"))
    bounded = rows.filter(F.col("search").isin(by(BOUNDED))).groupBy("search", "category", "subject", "first_sec", "last_sec", "slot").agg(
        F.max("n").alias("n"), *other)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [counted, highest, joined, bounded])
    return every.filter("_any_new = 1").withColumn("joined", F.col("_all_new") == 0).drop("_all_new", "_any_new")


def _gaps(new: DataFrame, known: DataFrame, search: int) -> DataFrame:
    """Gap sums of the batch's sources, those of before included; seconds at or before the last one known add no gap."""
    past = known.filter(F.col("search") == search).select(
        F.col("subject").alias("source_ip"), F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.col("first_sec").alias("_first"),
        F.col("last_sec").alias("_last"))
    seconds = det.seconds_of_sources(new).join(past.select("source_ip", "_last"), "source_ip", "left").filter("_last IS NULL OR sec > _last").drop("_last")
    both = gap_sums(seconds, ["source_ip"]).join(past, "source_ip", "left")
    bridge = F.when(F.col("_last").isNotNull(), (F.col("first_sec") - F.col("_last")).cast("decimal(38,0)"))
    add = lambda c, old, gap: (F.col(c) + F.coalesce(F.col(old), F.lit(0)) + F.coalesce(gap, F.lit(0))).cast("decimal(38,0)")
    return both.select(
        "source_ip", (F.col("gaps") + F.coalesce("_n", F.lit(0)) + F.when(bridge.isNotNull(), 1).otherwise(0)).alias("gaps"),
        add("s1", "_s1", bridge).alias("s1"), add("s2", "_s2", bridge * bridge).alias("s2"), F.least("_first", "first_sec").alias("first_sec"), "last_sec")


def search_lines(lines: DataFrame, out: str, batch_id: int, fmt: str | None = None, feed: str = WATCH, searches: Sequence[Search] = SEARCHES,
                 generated_at: Column | None = None, **parse_options) -> None:
    """Parse and search one batch of a watch, and store its lines, its alerts and what later batches need to know.

    An alert that goes on over batches is stored again, longer, under the id that it had. Its evidence are its first lines. Lines
    later than ``LATE`` may leave a run's shorter version beside the longer one. A source whose failed logins reach the band HIGH
    in a later batch keeps the alert of its lower band.
    """
    spark = lines.sparkSession
    path = folder(out, "parsed", batch_id, feed)
    det.tag(parse_corpus(number_lines(lines), fmt, dense=True, **parse_options)).write.mode("overwrite").parquet(path)
    new = spark.read.parquet(path)
    since, until = new.agg(F.min("sec"), F.max("sec")).first()
    state = materialize(read_state(spark, out, batch_id, feed))
    recent = new
    if since is not None:
        reach = max(s.reach for s in searches)
        batches = [r["slot"] for r in state.filter((F.col("search") == _SPANS) & (F.col("last_sec") >= since - reach)).select("slot").collect()]
        for b in sorted(batches):  # the few batches that the longest window still sees
            recent = recent.unionByName(spark.read.schema(new.schema).parquet(folder(out, "parsed", b, feed)).filter(F.col("sec") >= since - reach))

    def part(i: int, s: Search) -> DataFrame:
        found = s.find(new) if s.carry == TOTAL else s.find(recent).filter(F.lit(since is not None) & (F.col("last_sec") >= F.lit(since)))
        slot = F.floor(F.col("first_sec") / s.slot) if s.slot else F.col("first_sec") if s.carry in (RUN, BOUNDED) else F.lit(0)
        return found.withColumns({"search": F.lit(i), "slot": slot.cast("bigint")})

    parts = materialize(reduce(DataFrame.unionByName, [part(i, s) for i, s in enumerate(searches) if s.carry != GAPS]))
    known = state.join(parts.select("search", "subject").distinct(), ["search", "subject"], "left_semi")
    merged = materialize(_merged(parts, known, searches))

    gaps = {i: materialize(_gaps(new, state, i)) for i, s in enumerate(searches) if s.carry == GAPS}
    kept = F.lit(True)
    for i, s in enumerate(searches):
        if s.keep:
            kept = kept & ((F.col("search") != i) | F.expr(s.keep))
    beats = [searches[i].find(g).withColumn("search", F.lit(i)) for i, g in gaps.items()]
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), beats, merged)
    # evidence of a finding that went on are the lines kept with it, then those of this batch
    start = F.when(F.coalesce("joined", F.lit(False)), F.greatest("first_sec", F.lit(since))).otherwise(F.col("first_sec"))
    asked = materialize(found.withColumn("_true_first", F.col("first_sec")).withColumn("first_sec", start))
    categories = [r["category"] for r in asked.select("category").distinct().collect()]  # a handful of names
    shown = det.with_evidence(asked, det.evidence_lines(recent, categories))
    none = F.array().cast("array<string>")
    shown = materialize(shown.withColumn("first_sec", F.col("_true_first")).withColumns({
        "affected_lines": F.slice(F.concat(F.coalesce("lines", none), F.coalesce("affected_lines", none)), 1, MAX_AFFECTED_LINES),
        "source_file": F.coalesce("file", "source_file"), "log_format": F.coalesce(F.col("format"), F.col("log_format"))}))
    write_batch(det.to_alerts(shown.filter(kept).drop("lines", "file", "format"), generated_at), out, batch_id, feed)
    write_ioc_delta(spark, out, batch_id, feed)

    carried = [i for i, s in enumerate(searches) if s.carry in (TOTAL, PEAK, RUN)]
    rows = shown.filter(F.col("search").isin(carried)).select(
        "search", "category", "severity", "subject", "slot", "first_sec", "last_sec", "n", F.col("affected_lines").alias("lines"),
        F.col("source_file").alias("file"), F.col("log_format").alias("format"))
    sums = [g.select(F.lit(i).alias("search"), F.lit("gaps").alias("category"), F.col("source_ip").alias("subject"), F.lit(0).cast("bigint").alias("slot"),
                     "first_sec", "last_sec", F.col("gaps").alias("n"), "s1", "s2") for i, g in gaps.items()]
    span = spark.createDataFrame([(_SPANS, "lines", batch_id, since, until)], "search int, category string, slot bigint, first_sec bigint, last_sec bigint")
    changed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*sums, span], rows)
    empty = spark.createDataFrame([], STATE)
    _write_state(empty.unionByName(changed, allowMissingColumns=True), state, out, batch_id, feed, since, searches)
