"""Feeds read in ranges of bytes against the reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberlog.sources import feeds

ELEMENT = "struct<id:long,text:string,inner:array<struct<a:string>>>"


def document(seed, n):
    r = random.Random(seed)
    odd = ['{', '}', '[', ']', '"', '\\', '\\"', 'é', '日', ':', ',', '"items": [', 'x' * 30, '\n']
    text = lambda: "".join(r.choice(odd) for _ in range(r.randrange(8)))
    items = [{"id": i, "text": text(), "inner": [{"a": text()} for _ in range(r.randrange(3))]} for i in range(n)]
    parts = {"before": [{"id": -1, "text": text()}], "note": text(), "items": items, "items\\": [{"id": -2}], "deep": {"items": [{"id": -3}]}, "after": [{"id": -4}]}
    return json.dumps(parts, ensure_ascii=bool(seed % 2), indent=r.choice([None, 1])), items


@pytest.mark.parametrize("split", [1, 7, 50, 333, 1 << 20])
def test_ranges_cut_anywhere(spark, tmp_path, split):
    items = []
    for k in range(2 if split < 10 else 4):
        text, some = document(k, 4 if split < 10 else 25)
        (tmp_path / f"{k}.json").write_text(text, encoding="utf-8")
        items += some
    (tmp_path / "none.json").write_text('{"items": [], "x": 1}')
    (tmp_path / "object.json").write_text('{"items": {"a": {"id": 9}}}')
    got = feeds.split_list(spark, str(tmp_path), "items", ELEMENT, split)
    want = sorted((i["id"], i["text"], [x["a"] for x in i["inner"]]) for i in items)
    assert sorted((r.id, r.text, [x.a for x in r.inner]) for r in got.collect()) == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    text, items = document(1, 400)
    (tmp_path / "a.json").write_text(text)
    got = feeds.split_list(spark, str(tmp_path / "a.json"), "items", ELEMENT, len(text) // 5)
    tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 4 and sum(t["count"] for t in tasks) == 400
    whole = spark.read.schema(f"items array<{ELEMENT}>").json(str(tmp_path / "a.json"), multiLine=True).select(F.explode("items").alias("o")).select("o.*")
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert feeds.read_cve_feed(spark, str(tmp_path)).count() == 0


def test_small_ranges_go_on_together(spark):
    """Rows of many ranges are one batch, but no batch holds much more than HANDED bytes."""
    schema = feeds.pa.schema([("text", feeds.pa.string())])
    rows = feeds.pa.RecordBatch.from_pylist([{"n": n} for n in range(50)])
    few = list(feeds._each(iter([rows]), lambda n: [{"text": str(n)}] * (n % 3), schema))
    assert len(few) == 1 and few[0].column("text").to_pylist() == [str(n) for n in range(50) for _ in range(n % 3)]
    long = list(feeds._each(iter([rows]), lambda n: [{"text": "x" * (feeds.HANDED // 4)}], schema))
    assert [len(b) for b in long] == [4] * 12 + [2]


def test_feed_files_do_not_grow_in_number(spark):
    """A feed file per task without a folder each, whatever the number of objects; each is one JSON document."""
    import os

    from emberlog.plans.queries.intel import _written

    item = F.struct(F.struct(F.concat(F.lit("CVE-"), F.col("id").cast("string")).alias("ID")).alias("CVE_data_meta")).alias("cve")
    for n in (950, 1):
        path = _written(spark.range(0, n, 1, 3).select(item), "CVE_Items").removeprefix("file:")
        found = [f for f in os.listdir(path) if not f.startswith((".", "_"))]
        assert len(found) == 3 and all(os.path.isfile(f"{path}/{f}") for f in found)
        assert sum(len(json.load(open(f"{path}/{f}"))["CVE_Items"]) for f in found) == n
        got = feeds.read_cve_feed(spark, path, split_bytes=700)
        assert sorted(r[0] for r in got.select("cve.CVE_data_meta.ID").collect()) == sorted(f"CVE-{k}" for k in range(n))
