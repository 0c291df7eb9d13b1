"""Growing files followed over several triggers, restarts, and files that are cut or replaced."""

import random
import uuid

import pytest

from emberlog.sources.alert_tables import read_alerts
from emberlog.streaming import tail
from emberlog.streaming import watch as w


class Follow:
    """A query run to what there is now, again and again, from one checkpoint."""

    def __init__(self, spark, path, at, **options):
        self.spark, self.path, self.at, self.options, self.rows = spark, path, at, options, []

    def __call__(self):
        got = []

        def keep(batch, _):
            got.extend((r.source_file.rsplit("/", 1)[-1], r.raw) for r in batch.sort("source_file", "block_start").collect())

        df = tail.follow_lines(self.spark, str(self.path), **self.options)
        df.writeStream.foreachBatch(keep).option("checkpointLocation", str(self.at)).trigger(availableNow=True).start().awaitTermination()
        self.rows += got
        return got


def add(path, data):
    with open(path, "ab") as f:
        f.write(data.encode() if isinstance(data, str) else data)


def test_appended_lines_come_once_and_whole(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = Follow(spark, folder, tmp_path / "cp")
    assert run() == []
    add(folder / "a.log", "one\ntwo\nhal")
    add(folder / "b.log", "x\r\n\r\n  \ny\n")
    add(folder / "_hidden", "no\n")
    assert run() == [("a.log", "one"), ("a.log", "two"), ("b.log", "x"), ("b.log", "y")]
    assert run() == []
    add(folder / "a.log", "f\n")
    add(folder / "c.log", b"caf\xe9 \xff\nopen")
    assert run() == [("a.log", "half"), ("c.log", "caf� �")]
    add(folder / "c.log", " no more\n")
    assert run() == [("c.log", "open no more")]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_cut_anywhere(spark, tmp_path, monkeypatch, split):
    """Ranges smaller than lines, lines longer than what is read at once, and empty lines at the borders."""
    r = random.Random(split)
    lines = ["x" * r.choice([0, 1, 2, 6, 7, 8, 30, 200]) + str(i) * (i % 3) for i in range(60)]
    folder = tmp_path / "in"
    folder.mkdir()
    monkeypatch.setattr(tail, "PIECE", 16)
    source, data, seen = tail.Tail(str(folder), False, split), "\n".join(lines).encode(), []
    start = source.initialOffset()
    for end in (1, 50, 51, len(data) // 2, len(data)):
        (folder / "a.log").write_bytes(data[:end] + (b"\n" if end == len(data) else b""))
        now = source.latestOffset()
        parts = source.partitions(start, now)
        seen += [t for p in parts for b in source.read(p) for t in b.column(3).to_pylist()]
        start = now
    assert seen == [line for line in lines if line]


def test_cut_and_replaced_files_start_over(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = Follow(spark, folder, tmp_path / "cp")
    add(folder / "a.log", "one\ntwo\n")
    add(folder / "b.log", "b" * 3000 + "\nb2\n")
    run()
    (folder / "a.log").write_text("new\n")  # shorter
    (folder / "b.log").write_text("c" * 4000 + "\nb2\nb3\n")  # longer, with another start
    assert [(f, t[:5]) for f, t in run()] == [("a.log", "new"), ("b.log", "ccccc"), ("b.log", "b2"), ("b.log", "b3")]
    (folder / "a.log").unlink()
    assert run() == []
    add(folder / "a.log", "again\n")
    assert run() == [("a.log", "again")]


def test_one_file_from_its_end(spark, tmp_path):
    add(tmp_path / "a.log", "old\nhalf")
    run = Follow(spark, tmp_path / "a.log", tmp_path / "cp", from_end=True)
    assert run() == []
    add(tmp_path / "a.log", " line\nnew\n")
    assert run() == [("a.log", "half line"), ("a.log", "new")]


def test_watch_follows_a_growing_file(spark, tmp_path):
    """A burst written in two goes into one file is the burst that it is in one file written at once."""
    lines = [f"2024-05-01 10:01:{i:02d} gate sshd[1]: Failed password for root from 203.0.113.7 port 2 ssh2" for i in range(16)]
    found = {}
    for name, goes in (("two", (lines[:8], lines[8:])), ("one", (lines,))):
        (tmp_path / name).mkdir()
        for part in goes:
            add(tmp_path / name / "a.log", "\n".join(part) + "\n")
            w.watch(spark, str(tmp_path / name), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"), available_now=True, follow=True).awaitTermination()
        found[name] = sorted((a.title, a.timestamp_first, a.timestamp_last, a.description) for a in read_alerts(spark, str(tmp_path / f"{name}-out")).filter("severity = 'HIGH'").collect())
    assert len(found["one"]) == 1 and found["one"] == found["two"]


def test_a_running_query_takes_what_is_appended(spark, tmp_path):
    (tmp_path / "in").mkdir()
    name = "t" + uuid.uuid4().hex
    query = tail.follow_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        for k in range(3):
            add(tmp_path / "in" / "a.log", f"line {k}\nline {k}b\n")
            query.processAllAvailable()
    finally:
        query.stop()
    assert [r.raw for r in spark.table(name).collect()] == [f"line {k}{b}" for k in range(3) for b in ("", "b")]
