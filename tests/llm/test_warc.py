import gzip

import pytest
from pyspark.sql import functions as F

from emberlog.llm import warc


def record(kind, name, uri, date, http="", profile=None):
    head = f"WARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n"
    return head + (f"WARC-Profile: {profile}\r\n" if profile else "") + "\r\n" + http + "\r\n\r\n"


def ok(fields, body="body"):
    return "HTTP/1.1 200 OK\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n" + body


def again(fields):
    return "HTTP/1.1 304 Not Modified\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n"


PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
DAY = "2024-01-{:02d}T00:00:00Z"
RECORDS = [
    record("response", "r1", "http://www.A.org:80/x/?b=2&a=1&utm_source=f#top", DAY.format(1), ok([("ETag", '"1"'), ("Content-Length", 4), ("Cache-Control", "a"), ("X", "1"), ("X", "2")])),
    record("response", "r2", "https://a.org/x?a=1&b=2", DAY.format(3), ok([("ETag", 'W/"2"'), ("Last-Modified", "then")])),
    record("response", "e", "https://a.org/x?a=1&b=2", DAY.format(4), "HTTP/1.1 500 No\r\nETag: \"9\"\r\n\r\n"),
    record("revisit", "v1", "http://a.org/x?a=1&b=2", DAY.format(2), again([("etag", 'W/"1"'), ("cache-control", "b"), ("content-length", 0), ("X", "3"), ("Connection", "y"), ("Y", "1")]), PROFILE),
    record("revisit", "v2", "http://a.org/x?b=2&a=1", DAY.format(5), again([("ETag", '"2"')]), PROFILE),
    record("revisit", "v3", "http://a.org/x?b=2&a=1", DAY.format(5), again([("ETag", '"1"')]), PROFILE),
    record("revisit", "v4", "http://a.org/x?b=2&a=1", DAY.format(5), again([("Last-Modified", "then")]), PROFILE),
    record("revisit", "v5", "http://a.org/x?b=2&a=1", DAY.format(5), again([]), PROFILE),
    record("revisit", "v6", "http://a.org/x?b=2&a=1", DAY.format(1), again([("ETag", '"1"')]), PROFILE),  # at the time of r1
    record("revisit", "v7", "", DAY.format(9), again([("ETag", '"1"')]), PROFILE),
    record("revisit", "v8", "http://a.org/x?b=2&a=1", "some day", again([("ETag", '"1"')]), PROFILE),
    record("revisit", "v9", "http://a.org/x?b=2&a=1", DAY.format(2), again([("ETag", '"1"')])),  # by its status
    record("revisit", "id", "http://a.org/x?b=2&a=1", DAY.format(2), "", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
    "", None, "no record", "WARC-Type: revisit", "Warc-Type response\r\n\r\nHTTP/1.1",
]


def test_resolution(spark):
    records = warc.parse_records(spark.createDataFrame([(r,) for r in RECORDS], "value string"))
    assert records.count() == len(RECORDS)
    got = {r.record_id: r for r in warc.resolve_revisits(records).collect()}
    assert {k: (v.outcome, v.response_id) for k, v in got.items()} == {
        "<v1>": ("resolved", "<r1>"), "<v2>": ("resolved", "<r2>"), "<v3>": ("mismatch", "<r2>"), "<v4>": ("resolved", "<r2>"),
        "<v5>": ("no_validator", "<r2>"), "<v6>": ("no_response", None), "<v7>": ("no_response", None), "<v8>": ("no_response", None), "<v9>": ("resolved", "<r1>")}
    assert [tuple(h) for h in got["<v1>"].headers] == [("content-length", "4"), ("etag", 'W/"1"'), ("cache-control", "b"), ("x", "3")]
    assert got["<v3>"].headers is None
    full = {r.record_id: r.payload for r in warc.with_payload(warc.resolve_revisits(records), records).collect()}
    assert full["<v1>"] == "body" and set(full) == {"<v1>", "<v2>", "<v4>", "<v9>"}


@pytest.mark.parametrize("url,want", [
    ("HTTP://user@WWW2.Host.org:443/a/b//?utm_medium=x&z=1&&a=2#f", "host.org/a/b?a=2&z=1"), ("https://host.org", "host.org"), ("http://h/?", "h"),
    ("nothing", None), ("", None), (None, None), ("http:///x", None)])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_many_captures_of_one_url(spark):
    """The latest earlier one by hand, over many blocks of days, with repeated records."""
    data, want, last = [], {}, None
    for n in range(400):
        date = f"2024-{1 + n // 40:02d}-{1 + n % 28:02d}T{n % 24:02d}:00:00Z"
        data.append((date, n, n % 3 == 0))
    for date, n, response in sorted(data):
        if response:
            last = (date, n)
    texts = [record("response" if resp else "revisit", f"n{n}", "http://h/", date, (ok if resp else again)([("ETag", "e")]), None if resp else PROFILE) for date, n, resp in data]
    for date, n, resp in data:
        if not resp:
            before = [(d, k) for d, k, r in data if r and d < date]
            newest = max(before)[0] if before else None
            want[f"<n{n}>"] = newest and max(f"<n{k}>" for d, k in before if d == newest)
    records = warc.parse_records(spark.createDataFrame([(t,) for t in texts * 2], "value string"))
    got = warc.resolve_revisits(records).collect()
    assert len(got) == 2 * len(want) and {r.record_id: r.response_id for r in got} == want


def test_files(spark, tmp_path):
    version, plain = "WARC/1.0\r\n", RECORDS[:5]
    (tmp_path / "a.warc").write_bytes("".join(version + r for r in plain[:3]).encode())
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress((version + r).encode()) for r in plain[3:]))
    records = warc.parse_records(warc.read_warc(spark, str(tmp_path)))
    assert sorted(r.record_id for r in records.collect()) == sorted(["<r1>", "<r2>", "<e>", "<v1>", "<v2>"])
    assert records.filter("record_id = '<r1>'").first().payload == "body"


def test_empty_and_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "http://h/", "p", "x"), (2, "http://h/", "", "x"), (2, "http://h/", "", "x")], "page_id long, url string, html string, value string")
    found = warc.resolve_revisits(warc.parse_records(warc.render_captures(pages))).collect()
    assert sorted((r.record_id, r.outcome) for r in found) == [("<urn:again:1>", "no_response"), ("<urn:again:2>", "resolved"), ("<urn:again:2>", "resolved")]
    assert warc.resolve_revisits(warc.parse_records(warc.render_captures(pages.limit(0)))).count() == 0
