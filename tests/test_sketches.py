"""Summaries merged over batches against exact counts."""

import datetime as dt
import random
from collections import Counter

from emberlog.schema import ALERT, conform
from emberlog.sources import alert_sketches as sk
from emberlog.sources import alert_tables as tables


def store(spark, path, batch, iocs, feed="batch"):
    rows = [(str(i), "HIGH", x, dt.datetime(2024, 1, 1)) for i, x in enumerate(iocs)]
    tables.write_batch(conform(spark.createDataFrame(rows, "id string, severity string, iocs array<string>, generated_at timestamp"), ALERT), path, batch, feed)
    sk.write_sketches(spark, path, batch, feed)


def test_merged_counts(spark, tmp_path):
    r, path = random.Random(4), str(tmp_path)
    batches = [[[f"v{int(r.paretovariate(0.4)) % 30_000}" for _ in range(3)] for _ in range(6000)] for _ in range(3)]
    for k, b in enumerate(batches):
        store(spark, path, k % 2, b, "batch" if k < 2 else "watch")
    store(spark, path, 1, batches[1])  # again is harmless
    exact = Counter(v for b in batches for x in b for v in x)
    row = sk.read_sketches(spark, path, 20).first()
    assert row.occurrences == sum(exact.values()) and abs(row.distinct_iocs - len(exact)) <= sk.DISTINCT_ERROR * len(exact)
    slack = 2 * row.occurrences / sk.TRACKED
    assert len(row.top) == 20 and all(abs(t.n - exact[t.value]) <= slack for t in row.top)
    assert min(t.n for t in row.top) >= exact.most_common(20)[-1][1] - slack
    assert sk.read_sketches(spark, path, 1, "watch").first().occurrences == 18_000


def test_nothing(spark, tmp_path):
    store(spark, str(tmp_path), 0, [[], None])
    assert sk.read_sketches(spark, str(tmp_path)).count() == 0
