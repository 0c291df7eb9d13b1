"""Searches by postings find what searches of all alerts find, and read less."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import alerts as ops
from emberlog.schema import ALERT, conform
from emberlog.sources import alert_index as ix
from emberlog.sources import alert_tables as tables


def some(spark, seed, ids, day):
    r = random.Random(seed)
    rows = [(str(i), r.choice(["HIGH", "LOW", "INFO"]), f"Title {r.choice(['Alpha', 'beta', 'gAmma'])} {r.randrange(30)}", None if i % 7 == 0 else f"Größe {r.randrange(20)} of {i}",
             [] if i % 5 == 0 else [f"10.0.0.{r.randrange(9)}", r.choice(["x.example", "áb"])], dt.datetime(2024, 1, day)) for i in ids]
    return conform(spark.createDataFrame(rows, "id string, severity string, title string, description string, iocs array<string>, generated_at timestamp"), ALERT)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Three batches of two feeds; the later ones hold new versions of some alerts."""
    path = str(tmp_path_factory.mktemp("store"))
    for batch, feed, ids in ((0, "batch", range(200)), (1, "batch", range(150, 260)), (0, "watch", range(250, 300))):
        tables.write_batch(some(spark, batch + len(feed), ids, 1 + batch), path, batch, feed)
        for _ in range(2):  # again is harmless
            ix.write_index(spark, path, batch, feed)
    return path


def rows(df):
    return [(a.id, a.severity, a.title, a.generated_at) for a in df.collect()]


@pytest.mark.parametrize("term", ["alpha 1", "GAMMA", "größe 1", "10.0.0.3", "x.ex", "áb", "ti", "", "no such text", "of 17", "%", "Title"])
def test_text(spark, store, term):
    want = rows(ops.by_text(tables.read_alerts(spark, store), term, 400))
    assert sorted(rows(ix.find_text(spark, store, term, 400))) == sorted(want)
    assert len(rows(ix.find_text(spark, store, term, 3))) == min(3, len(want))


@pytest.mark.parametrize("value", ["10.0.0.4", "x.example", "10.0.0", "none"])
def test_iocs(spark, store, value):
    assert sorted(rows(ix.find_ioc(spark, store, value))) == sorted(rows(ops.by_ioc(tables.read_alerts(spark, store), value)))


def test_one_bucket_is_read(spark, store):
    found = ix.postings(spark, store, ix.IOCS, ["10.0.0.4"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "bucket" in filters and "kind" in filters and "term" in plan[plan.index("PushedFilters"):]
    assert len({f.split("bucket=")[1].split("/")[0] for f, in found.select(F.input_file_name()).distinct().collect()}) == 1


def test_long_lists_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "LISTED", 20)
    monkeypatch.setattr(ix, "FOLDERS", 1)
    path = str(tmp_path)
    tables.write_batch(some(spark, 3, range(100), 1), path, 0)
    ix.write_index(spark, path, 0)
    lists = ix.postings(spark, path, ix.TRIGRAMS, ["tit"])
    assert lists.count() > 3 and lists.agg(F.sum(F.size("places"))).first()[0] == 100
    assert sorted(rows(ix.find_text(spark, path, "title", 400))) == sorted(rows(tables.read_alerts(spark, path)))


def test_empty_batch(spark, tmp_path):
    tables.create(spark, str(tmp_path))
    ix.write_index(spark, str(tmp_path), -1)
    assert ix.find_text(spark, str(tmp_path), "anything").count() == ix.find_ioc(spark, str(tmp_path), "x").count() == 0


def test_postings_stay_in_their_task(spark, tmp_path):
    """An index is written by one stage without a shuffle, and its postings are numbers of a piece."""
    path, sc = str(tmp_path), spark.sparkContext
    tables.write_batch(some(spark, 5, range(300), 1), path, 0)
    sc.setJobGroup("index", "index")
    try:
        ix.write_index(spark, path, 0)
        jobs = sc.statusTracker().getJobIdsForGroup("index")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobInfo(max(jobs)).stageIds) == 1
    assert dict(ix.postings(spark, path, ix.TRIGRAMS, ["tit"]).dtypes)["places"] == "array<int>"


@pytest.mark.parametrize("size", [1, 300])
def test_pieces_cut_by_bytes(spark, tmp_path, monkeypatch, size):
    """Pieces of few bytes, letters beyond 16 bits, nulls among indicators, and two rows of an id in one batch."""
    monkeypatch.setattr(ix, "BYTES", size)
    day = dt.datetime(2024, 1, 1)
    rows_ = [("1", "HIGH", "A😀b İx", None, [None, "10.1.1.1"], day), ("1", "LOW", "newer", "", None, day + dt.timedelta(1)), ("2", "LOW", None, "say a😀B", ["10.1.1.1", "10.1.1.1"], day),
             (None, "LOW", "a😀b", None, ["10.1.1.1"], day), ("3", "INFO", "İX ab", "😀b", [], day), ("4", "INFO", "A😀", "b", ["a😀", "b"], day)]
    rows_ += [(str(k), "HIGH", f"a😀b {k}", "long " * k, [f"h{k}"], day) for k in range(10, 40)]
    path = str(tmp_path)
    tables.write_batch(conform(spark.createDataFrame(rows_, "id string, severity string, title string, description string, iocs array<string>, generated_at timestamp"), ALERT), path, 0)
    ix.write_index(spark, path, 0)
    assert ix.postings(spark, path, ix.TRIGRAMS, ["a😀b"]).count() > 3
    known = tables.read_alerts(spark, path).filter("id IS NOT NULL")
    for term in ("A😀B", "İx", "İX ", "long long", "10.1.1.1"):
        assert sorted(rows(ix.find_text(spark, path, term, 99)), key=str) == sorted(rows(ops.by_text(known, term, 99)), key=str)
    assert sorted(rows(ix.find_ioc(spark, path, "10.1.1.1")), key=str) == sorted(rows(ops.by_ioc(known, "10.1.1.1")), key=str)
