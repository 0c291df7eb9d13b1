"""Reports, stored tables, export and indicators."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators import alerts as ops
from emberlog.operators import budget
from emberlog.schema import ALERT, conform
from emberlog.sources import alert_tables as store


def make(spark, rows):
    cols = ["id", "severity", "title", "iocs", "source_file", "generated_at"]
    df = spark.createDataFrame([tuple(r) for r in rows],
                               "id string, severity string, title string, iocs array<string>, source_file string, generated_at timestamp")
    assert df.columns == cols
    return conform(df.withColumn("description", F.concat(F.lit("about "), "title")), ALERT)


def at(n):
    return dt.datetime(2024, 1, 1, 0, 0, n)


ROWS = [
    ("1", "CRITICAL", "Breach", ["1.1.1.1", "root"], "/a", at(1)),
    ("2", "LOW", "50% of_max", ["11.1.1.1"], "/b", at(3)),
    ("3", "HIGH", "Brute", ["1.1.1.1", "1.1.1.1", "ÄB", "x"], "/a", at(2)),
]


def ids(df):
    return [r.id for r in df.collect()]


def test_queries(spark):
    a = make(spark, ROWS)
    assert ids(ops.by_severity(a, "HIGH")) == ["3", "1"] and ids(ops.by_severity(a, "INFO")) == ["2", "3", "1"]
    with pytest.warns(UserWarning):
        assert len(ids(ops.by_severity(a, "weird"))) == 3
    assert ids(ops.by_ioc(a, "1.1.1.1")) == ["3", "1"] and ids(ops.by_ioc(a, "1.1.1")) == []
    assert ids(ops.by_source(a, "/a")) == ["3", "1"] and ids(ops.recent(a, 2)) == ["2", "3"]
    assert ids(ops.by_text(a, "bR")) == ["3", "1"] and ids(ops.by_text(a, "%")) == ["2"] and ids(ops.by_text(a, "_")) == ["2"]
    assert ids(ops.by_text(a, "Äb")) == ["3"] and ids(ops.by_text(a, "äb")) == []  # only ASCII letters fold
    assert ids(ops.by_text(a, "about", 2)) == ["2", "3"]
    assert [(r.severity, r.n) for r in ops.severity_table(a).collect()] == [("CRITICAL", 1), ("HIGH", 1), ("LOW", 1)]


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "db")
    store.create(spark, path)
    assert store.read_alerts(spark, path).count() == 0 and store.read_iocs(spark, path).count() == 0
    for _ in range(2):  # a batch written again counts once
        store.write_batch(make(spark, ROWS), path, 0)
        store.write_ioc_delta(spark, path, 0)
    assert store.read_alerts(spark, path).count() == 3
    mart = {r.value: r for r in store.read_iocs(spark, path).collect()}
    assert mart["1.1.1.1"].alert_count == 3 and mart["1.1.1.1"].type == "ip" and mart["1.1.1.1"].first_seen == at(1)
    assert [(r.value, r.alert_count) for r in ops.top_iocs(store.read_iocs(spark, path), 2).collect()] == [
        ("1.1.1.1", 3), ("11.1.1.1", 1)]
    store.write_batch(make(spark, [("1", "INFO", "Again", ["9.9.9.9"], "/c", at(9))]), path, 1)
    store.write_ioc_delta(spark, path, 1)
    assert {r.id: r.title for r in store.read_alerts(spark, path).collect()}["1"] == "Again"
    assert store.read_alerts(spark, path).count() == 3 and store.read_alerts(spark, path, 1).count() == 1
    counters = {r.value: r.alert_count for r in store.read_ioc_counters(spark, path).collect()}
    assert counters["9.9.9.9"] == 1 and counters["1.1.1.1"] == 3
    assert {r.value: r.alert_count for r in store.read_iocs(spark, path).collect()}["1.1.1.1"] == 2
    plan = ops.at_least(spark.read.parquet(f"{path}/alerts"), "HIGH")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "severity" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.clear(spark, path)
    assert store.read_alerts(spark, path).count() == 0 and store.read_ioc_counters(spark, path).count() == 0


def test_export(spark, tmp_path):
    store.export_json(make(spark, ROWS).filter("id = '1'"), str(tmp_path / "out"))
    (line,) = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    row = json.loads(line)
    assert list(row) == ["id", "severity", "title", "description", "recommendation", "iocs", "log_format", "source_file",
                         "chunk_index", "timestamp_first", "timestamp_last", "generated_at"]
    assert row["timestamp_first"] is None and row["generated_at"] == "2024-01-01T00:00:01" and row["iocs"] == ["1.1.1.1", "root"]


def test_decode_and_upsert(spark):
    df = spark.createDataFrame([('["a"]', None)], "iocs string, affected_lines string")
    assert tuple(store.decode_json_arrays(df).first()) == (["a"], [])
    a = make(spark, ROWS)
    assert ops.upsert(a, a.filter("id = '2'").withColumn("title", F.lit("new"))).filter("title = 'new'").count() == 1
    plan = ops.upsert(a, a)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # also before the shuffle


def test_digest_and_plan(spark):
    a = make(spark, ROWS).withColumns({
        "affected_lines": F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.rpad(i.cast("string"), 200, "x")),
        "remediation": F.struct(F.lit("block_ip").alias("action"), F.lit("c").alias("command"),
                                (F.col("id") == "1").alias("reversible"), F.lit("u").alias("undo_command"))})
    d = {r.id: r for r in ops.digest(conform(a, ALERT)).collect()}
    assert d["3"].iocs == "1.1.1.1, 1.1.1.1, ÄB…" and d["1"].iocs == "1.1.1.1, root" and d["1"].more_lines == "... 2 more"
    assert [len(x) for x in d["1"].lines.split("\n")] == [120, 120, 120] and d["1"].at == "2024-01-01T00:00:01"
    assert {r.id: r.undo for r in ops.remediation_plan(conform(a, ALERT)).collect()} == {"1": "u", "2": None, "3": None}


def test_budget(spark):
    df = spark.createDataFrame([("c", "x" * 2984), ("d", None), ("d", "abcd" * 9)], "k string, t string")
    tokens = {r.k: r.tokens for r in budget.messages_tokens(df, ["k"], "t").collect()}
    assert tokens == {"c": 750, "d": 5 + 13}
    row = spark.range(1).select(
        budget.is_over_threshold(F.lit(750), 1000).alias("edge"), budget.is_over_threshold(F.lit(749), 1000).alias("under"),
        budget.used(F.lit(10), F.lit("x" * 8)).alias("used"), budget.used(F.lit(10), F.lit("")).alias("bare"),
        budget.array_tokens(F.array(F.struct(F.lit("user").alias("role"), F.lit("x" * 8).alias("content")))).alias("arr")).first()
    assert tuple(row) == (True, False, 12, 10, 6)
