"""The watch folder and the windowed streams, run to the end of their input and compared with batch results."""

import datetime as dt
import json
import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog import parse_lines
from emberlog.operators.detectors import success_after_failures
from emberlog.sources.alert_tables import read_alerts, read_ioc_counters
from emberlog.streaming import watch as w
from emberlog.streaming import windows


def failures(ip, minute, n, name="root"):
    return [f"2024-05-01 10:{minute:02d}:{i:02d} gate sshd[1]: Failed password for {name} from {ip} port 2 ssh2" for i in range(n)]


def test_watch(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    seen = []
    run = lambda: w.watch(
        spark, str(folder), out, checkpoint, available_now=True, min_severity="HIGH",
        on_alerts=lambda alerts, batch: seen.append((batch, sorted(a.title for a in alerts.collect())))).awaitTermination()
    (folder / "a.log").write_text("\n".join(failures("203.0.113.1", 1, 12)) + "\n\n")
    run()
    (folder / "b.log").write_text("\n".join(failures("203.0.113.1", 2, 11) + failures("203.0.113.2", 3, 2)))
    run()
    run()  # nothing new
    assert seen == [(0, ["Brute force from 203.0.113.1"]), (1, ["Brute force from 203.0.113.1"])]
    assert read_alerts(spark, out).count() == 2
    # one burst over both batches, stored twice, and two failures of another source
    assert {r.title for r in read_alerts(spark, out).collect()} == {"Brute force from 203.0.113.1", "Failed logins from 203.0.113.2"}
    assert {r.value: r.alert_count for r in read_ioc_counters(spark, out).collect()} == {"203.0.113.1": 2, "203.0.113.2": 1}


def test_a_burst_over_two_batches(spark, tmp_path):
    """Eight failures in each of two files, read one at a time, are the burst that they are in one file."""
    lines = failures("203.0.113.7", 1, 16)
    for folder, parts in (("two", (lines[:8], lines[8:])), ("one", (lines,))):
        (tmp_path / folder).mkdir()
        for k, part in enumerate(parts):
            (tmp_path / folder / f"{k}.log").write_text("\n".join(part))
            os.utime(tmp_path / folder / f"{k}.log", (1_700_000_000 + k, 1_700_000_000 + k))
        w.watch(spark, str(tmp_path / folder), str(tmp_path / f"{folder}-out"), str(tmp_path / f"{folder}-cp"), available_now=True,
                max_files_per_trigger=1).awaitTermination()
    got = {f: sorted((a.id, a.title, a.timestamp_first, a.timestamp_last, a.description) for a in read_alerts(spark, str(tmp_path / f"{f}-out")).filter(
        "severity = 'HIGH'").collect()) for f in ("one", "two")}
    assert len(got["one"]) == 1 and got["one"] == got["two"]


def test_a_new_checkpoint_starts_a_new_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")
    for k in (1, 2):
        (tmp_path / "in" / "a.log").write_text("\n".join(failures(f"203.0.113.{k}", 1, 12)))
        w.watch(spark, str(tmp_path / "in"), out, str(tmp_path / f"cp{k}"), available_now=True).awaitTermination()
    assert {r.title for r in read_alerts(spark, out).collect()} == {"Brute force from 203.0.113.1", "Brute force from 203.0.113.2"}


def test_since_leaves_out_old_files(spark, tmp_path):
    (tmp_path / "old.log").write_text("x\n")
    df = w.tail_lines(spark, str(tmp_path), since=str(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(hours=1)))
    assert collect(spark, df, "append") == []


def collect(spark, df, mode):
    name = "s" + uuid.uuid4().hex
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


@pytest.fixture()
def log(tmp_path):
    """Two files and, for append mode, a last line far ahead that lets every earlier window close."""
    (tmp_path / "1.log").write_text("\n".join(failures("203.0.113.1", 1, 5) + failures("203.0.113.2", 3, 3)))
    (tmp_path / "2.log").write_text("\n".join(failures("203.0.113.1", 4, 2) + failures("203.0.113.1", 40, 2)))
    (tmp_path / "3.log").write_text(failures("203.0.113.9", 1, 1)[0].replace("2024", "2030"))
    return str(tmp_path)


def streamed(spark, path):
    lines = w.tail_lines(spark, path, max_files_per_trigger=1).select("source_file", "raw")
    return parse_lines(lines, "syslog")


def stored(spark, path):
    return parse_lines(spark.read.text(path).select(F.col("value").alias("raw"), F.lit("").alias("source_file")), "syslog").filter(
        "event_ts < '2030-01-01'")


def flat(df):
    return df.select("source_ip", F.col("window.start").alias("a"), F.col("window.end").alias("b"), "failures")


def test_sliding_failures(spark, log):
    got = collect(spark, flat(windows.sliding_failures(streamed(spark, log), watermark="3 hours")), "append")
    want = [tuple(r) for r in flat(windows.sliding_failures(stored(spark, log))).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5


def test_line_rate(spark, log):
    shape = lambda d: d.select("host", F.col("window.start").alias("a"), "lines")
    got = collect(spark, shape(windows.line_rate(streamed(spark, log), watermark="3 hours")), "append")
    assert sorted(got) == sorted(tuple(r) for r in shape(windows.line_rate(stored(spark, log))).collect())


def test_login_sessions(spark, log):
    got = collect(spark, windows.login_sessions_stream(streamed(spark, log), 600, "3 hours"), "append")
    want = [tuple(r) for r in windows.login_sessions(stored(spark, log), 600).collect()]
    assert sorted(got) == sorted(want) and len(want) == 3


def test_late_lines_are_dropped(spark, tmp_path):
    for name, minute in (("1.log", 50), ("2.log", 55), ("3.log", 1), ("4.log", 56)):
        (tmp_path / name).write_text(failures("203.0.113.1", minute, 1)[0])
        os.utime(tmp_path / name, (10**9 + int(name[0]), 10**9 + int(name[0])))  # read in this order
    df = windows.line_rate(streamed(spark, str(tmp_path))).select(F.minute("window.start").alias("m"), "lines")
    assert collect(spark, df, "update") == [(50, 1), (55, 1), (55, 2)]


def test_dedupe(spark, tmp_path):
    schema = "id string, generated_at timestamp"
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 1))], schema)
    rows.write.parquet(str(tmp_path / "x"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "x"))
    assert sorted(r[0] for r in collect(spark, windows.dedupe_alerts(stream), "append")) == ["a", "b"]
    assert windows.dedupe_alerts(rows).count() == 2


def test_numbering_and_context_go_on(spark, tmp_path):
    state = str(tmp_path / "state")
    first = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "source_file string, chunk_index bigint")
    for _ in range(2):  # a batch run again keeps its numbers
        numbered = w.continue_numbering(first, spark, state, 0)
        assert sorted((r.source_file, r.chunk_index, r.run_index) for r in numbered.collect()) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 2)]
        line = F.concat(F.lit("[chunk "), F.col("run_index").cast("string"), F.lit("] "), F.repeat(F.lit("z"), 700))
        w.store_context(numbered.withColumn("line", line), state, 0)
    assert [r.run_index for r in w.continue_numbering(first.limit(1), spark, state, 1).collect()] == [3]
    assert w.earlier_context(spark, state, 0) == ""
    text = w.earlier_context(spark, state, 1)
    assert text.startswith("...\n") and len(text) == 1504 and text.endswith("[chunk 2] " + "z" * 700)


def test_scored_batches(spark, tmp_path):
    out = str(tmp_path / "db")
    lines = lambda name: spark.createDataFrame(
        [(name, i, f"{name} {i} " + "x" * 4000, "syslog") for i in range(3)],
        "source_file string, line_no bigint, raw string, format string")

    @F.pandas_udf("string")
    def model(messages: pd.Series) -> pd.Series:
        def answer(m):
            seen = m[1]["content"] if len(m) > 2 else "nothing"
            return json.dumps({"alerts": [{"title": seen[-20:], "severity": "LOW"}], "chunk_summary": ""})

        return messages.map(answer)

    for batch_id, name in ((0, "a"), (1, "b"), (1, "b")):
        w.score_batch(lines(name), out, batch_id, model, "rules", "fix")
    got = {(r.source_file, r.chunk_index): r.title for r in read_alerts(spark, out).collect()}
    assert got == {("a", i): "nothing" for i in range(3)} | {("b", i + 3): "[chunk 2] LOW: nothing"[-20:] for i in range(3)}


def test_success_after_failures_on_a_stream(spark, tmp_path):
    """Two streams joined by time find what windows find in the stored log."""
    accepted = lambda ip, minute, s: f"2024-05-01 10:{minute:02d}:{s:02d} gate sshd[1]: Accepted password for root from {ip} port 2 ssh2"
    files = [failures("203.0.113.1", 1, 5) + failures("203.0.113.2", 1, 3) + [accepted("203.0.113.3", 1, 9)],
             [accepted("203.0.113.1", 4, 2), accepted("203.0.113.1", 4, 2), *failures("203.0.113.1", 4, 4), accepted("203.0.113.2", 58, 1)],
             [accepted("203.0.113.1", 30, 0), failures("203.0.113.9", 1, 1)[0].replace("2024", "2030")]]
    for k, lines in enumerate(files):
        (tmp_path / f"{k}.log").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / f"{k}.log", (10**9 + k, 10**9 + k))
    want = [(f.subject, f.first_sec, f.last_sec, f.n) for f in success_after_failures(stored(spark, str(tmp_path)), 1800).collect()]
    got = collect(spark, windows.success_after_failures_stream(streamed(spark, str(tmp_path)), 1800, watermark="2 hours"), "append")
    assert sorted(got) == sorted(want) and len(want) == 2 and {w[0] for w in want} == {"203.0.113.1"}
