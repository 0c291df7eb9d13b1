"""Parsers on single lines, detection, files and in-memory lines."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog import number_lines, parse_corpus, parse_lines, register_format, scan_lines
from emberlog.functions.csvline import split_csv
from emberlog.functions.scalars import register_sql_functions
from emberlog.operators.detect_format import detect_formats
from emberlog.operators.parse import unregister_format
from emberlog.schema import entry
from emberlog.sources.lines import lines_from, sample_lines

BSD = "Mar  3 04:05:06 gate sshd[99]: Failed password for amy from 198.51.100.7 port 22 ssh2"
BSD_NO_PID = "Mar 13 04:05:06 gate cron: job done"
RFC = "<34>1 2024-03-03T04:05:06.5+02:00 gate sshd 99 - - session from 198.51.100.7"
JOURNAL = "2024-03-03 04:05:06 gate sshd[99]: hello 198.51.100.8"
CLF = '198.51.100.7 - amy [03/Mar/2024:04:05:06 +0530] "GET /a?b=1 HTTP/1.1" 403 12 "-" "curl/8"'


def lines(spark, texts, source="f.log"):
    rows = [(source, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "source_file string, line_no bigint, raw string")


def parse(spark, texts, fmt, **options):
    return parse_lines(lines(spark, texts), fmt, **options).orderBy("line_no").collect()


def test_syslog_grammars(spark):
    bsd, no_pid, rfc, journal, pri = parse(spark, [BSD, BSD_NO_PID, RFC, JOURNAL, "<191>" + BSD], "syslog")
    assert (bsd.format, bsd.host, bsd.process, bsd.pid, bsd.source_ip) == ("syslog", "gate", "sshd", "99", "198.51.100.7")
    assert bsd.event_ts == dt.datetime(2000, 3, 3, 4, 5, 6) and bsd.facility is None and bsd.level is None
    assert bsd.extra == {"process": "sshd", "pid": "99"}
    assert no_pid.pid is None and no_pid.message == "job done" and no_pid.extra == {"process": "cron", "pid": None}
    assert (rfc.facility, rfc.level, rfc.source_ip, rfc.pid) == ("auth", "CRITICAL", None, None)
    assert rfc.event_ts == dt.datetime(2024, 3, 3, 2, 5, 6, 500000) and rfc.extra == {"process": "sshd"}
    assert journal.event_ts == dt.datetime(2024, 3, 3, 4, 5, 6) and journal.source_ip == "198.51.100.8"
    assert (pri.facility, pri.level) == ("23", "DEBUG")


def test_syslog_bad_times_and_years(spark):
    feb, month, year = parse(spark, ["Feb 29 00:00:00 h p: m", "Foo 29 00:00:00 h p: m", "Mar  3 04:05:06 h p: m"], "syslog")
    assert feb.event_ts == dt.datetime(2000, 2, 29)
    assert month.format == "syslog" and month.event_ts is None
    assert parse(spark, ["Mar  3 04:05:06 h p: m"], "syslog", base_year=2024)[0].event_ts.year == 2024


@pytest.mark.parametrize("fmt", ["syslog", "clf", "json", "windows_csv"])
def test_nothing_fails_or_vanishes(spark, fmt):
    junk = ["", "   ", "!!!", "null", "<>", "Jan", "[]", "42", "{}", "not json {{{", '"', '"a', "a,b\tc", "<99999999999999999999>x",
            "\u0000", "{\"a\":", "1.2.3.4 only"]
    rows = parse(spark, junk, fmt, header=["x", "y", "z"])
    assert [r.raw for r in rows] == junk
    assert all(r.message is not None and r.format is not None for r in rows)


def test_unknown_lines_keep_address_only_for_syslog(spark):
    text = "nothing to see from 203.0.113.9 here"
    assert parse(spark, [text], "syslog")[0].source_ip == "203.0.113.9"
    assert parse(spark, [text], "clf")[0].source_ip is None
    assert parse(spark, ['["203.0.113.9"]'], "json")[0].source_ip is None


def test_clf(spark):
    a, bare, short, dash, err = parse(spark, [
        CLF, '::1 - - [bad] "GET /x HTTP/1.0" 200 -', '1.1.1.1 - - [03/Mar/2024:04:05:06 +0000] "GET /x" 299 0',
        '- - - [03/Mar/2024:04:05:06 +0000] "" 404 0', 'h - - [03/Mar/2024:04:05:06 +0000] "GET / HTTP/1.1" 500 5 "r" "-"'], "clf")
    assert (a.method, a.path, a.status_code, a.level, a.auth_user, a.user_agent, a.referer) == (
        "GET", "/a?b=1", 403, "WARNING", "amy", "curl/8", None)
    assert a.message == "GET /a?b=1 → 403" and a.event_ts == dt.datetime(2024, 3, 2, 22, 35, 6)
    assert a.extra == {"method": "GET", "path": "/a?b=1", "status_code": "403", "bytes_sent": "12", "auth_user": "amy",
                       "user_agent": "curl/8"}
    assert bare.format == "clf" and bare.event_ts is None and bare.bytes_sent == "-" and bare.level == "INFO"
    assert short.method is None and short.path == "GET /x" and short.message == "? GET /x → 299"
    assert dash.source_ip is None and dash.path == "" and dash.message == "?  → 404"
    assert err.level == "ERROR" and err.referer == "r" and err.user_agent is None


def test_json_objects(spark):
    rows = parse(spark, [
        '{"timestamp":"2024-03-03T04:05:06Z","level":"fatal","message":"boom","src_ip":"1.2.3.4","k":1,"n":null}',
        '{"time":"2024-03-03 04:05:06","severity":"odd","msg":"from 5.6.7.8","server":"s"}',
        '{"timestamp":null,"time":"2024-03-03T04:05:06"}',
        '{"ts":1709438706,"lvl":"warn","text":{"a":[{"b":1}]}}',
        '{"@timestamp":"2024-03-03T04:05:06.123+05:00","message":"x","message":"y"}',
    ], "json")
    assert (rows[0].level, rows[0].source_ip, rows[0].message, rows[0].extra) == (
        "CRITICAL", "1.2.3.4", "boom", {"k": "1", "n": None})
    assert (rows[1].level, rows[1].source_ip, rows[1].host) == ("ODD", "5.6.7.8", "s")
    assert rows[1].event_ts == dt.datetime(2024, 3, 3, 4, 5, 6)
    assert rows[2].event_ts is None and rows[2].message == rows[2].raw
    assert rows[3].event_ts is None and rows[3].level == "WARNING" and rows[3].message == '{"a":[{"b":1}]}'
    assert rows[4].event_ts == dt.datetime(2024, 3, 3, 4, 5, 6) and rows[4].message == "y"
    kept = parse(spark, ['{"@timestamp":"2024-03-03T04:05:06.123+05:00"}'], "json", apply_offset=True)[0]
    assert kept.event_ts == dt.datetime(2024, 3, 2, 23, 5, 6, 123000)


def test_json_rejects_what_is_not_one_object(spark):
    bad = ['{"a":1} x', '{"a":1}]', '{"a":1}] {}', '{"a":1},{"b":2}', "[]", "null", "42", '"s"', "", "{'a':1}", '[{"a":1}]']
    good = ["{}", ' {"a":1} ', '{"a":[{"b":1}]}', '{"a":[{"b":1} ] , "c":2}']
    rows = parse(spark, bad + good, "json")
    assert [r.format for r in rows] == ["unknown"] * len(bad) + ["json"] * len(good)


def test_csv_fields(spark):
    cases = {"a,b": ["a", "b"], "a,,b,": ["a", "", "b", ""], '"x""y",z': ['x"y', "z"], '"a,b" ,c': ["a,b ", "c"],
             '"open, end': ["open, end"], 'mid"dle,"": x': ['mid"dle', ": x"], "": [""]}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", split_csv(F.col("raw")).alias("f"))
    assert {r.raw: r.f for r in df.collect()} == cases
    long = '"' + "ab\"\"" * 60_000 + '",z'
    assert spark.createDataFrame([(long,)], "raw string").select(F.size(split_csv(F.col("raw")))).first()[0] == 2


def test_windows_csv(spark):
    texts = ["TimeCreated,Id,LevelDisplayName,Message,Computer,UserName,Extra,Extra",
             '3/4/2024 1:02:03 PM,4625,Audit Failure,"tried ""x"", from 9.8.7.6",PC,D\\amy,first,second',
             "2024-03-04T01:02:03,1,Verbose,,PC,,,", "short,row", "31/12/2024 23:00:00,,Critical,m,,,,only"]
    rows = parse_corpus(lines(spark, texts, "w.csv"), "windows_csv").orderBy("line_no").collect()
    head, full, empty, short, last = rows
    assert head.message == "[CSV header]" and head.format == "windows_csv"
    assert (full.level, full.event_id, full.account_name, full.source_ip, full.host) == ("WARNING", "4625", "D\\amy", "9.8.7.6", "PC")
    assert full.message == 'tried "x", from 9.8.7.6' and full.event_ts == dt.datetime(2024, 3, 4, 13, 2, 3)
    assert full.extra == {"event_id": "4625", "account_name": "D\\amy", "Extra": "second"}
    assert empty.message == empty.raw and empty.level == "DEBUG" and empty.event_ts == dt.datetime(2024, 3, 4, 1, 2, 3)
    assert short.format == "unknown" and short.message == "short,row"
    assert last.event_ts == dt.datetime(2024, 12, 31, 23) and last.event_id is None and last.extra == {"Extra": "only"}


def formats(df, **options):
    return {r.source_file: r.format for r in detect_formats(df, **options).collect()}


def test_detection(spark):
    df = (
        lines(spark, [BSD, BSD_NO_PID, RFC, JOURNAL], "a")
        .unionByName(lines(spark, [CLF] * 3, "b"))
        .unionByName(lines(spark, ["{}", "x", "x"], "c"))                 # 1/3 is enough
        .unionByName(lines(spark, ["{}", "x", "x", "x"], "d"))            # 1/4 is not
        .unionByName(lines(spark, ["Id,foo,bar", "1,2,3"], "e"))          # one known header name is enough
        .unionByName(lines(spark, ["foo,bar", "1,2"], "f.CSV"))           # the name alone is not
        .unionByName(lines(spark, [BSD, CLF], "g"))                       # a tie goes to the earlier format
        .unionByName(lines(spark, ["x"] * 20 + [BSD] * 200, "h"))         # only the first 20 lines count
    )
    assert formats(df) == {"a": "syslog", "b": "clf", "c": "json", "d": "unknown", "e": "windows_csv", "f.CSV": "unknown",
                           "g": "syslog", "h": "unknown"}


def test_registered_format(spark):
    register_format("pipe", lambda raw: raw.contains("|"), lambda raw: entry(
        format=F.lit("pipe"), message=F.element_at(F.split(raw, r"\|"), 2)))
    try:
        df = lines(spark, ["a|b", "c|d"], "p").unionByName(lines(spark, [CLF], "q"))
        rows = {(r.source_file, r.line_no): (r.format, r.message) for r in parse_corpus(df).collect()}
        assert rows[("p", 0)] == ("pipe", "b") and rows[("q", 0)][0] == "clf"
    finally:
        unregister_format("pipe")
    with pytest.raises(ValueError):
        register_format("clf", None, None)


def test_files_keep_their_order(spark, tmp_path):
    expected = {}
    for name, n in (("one.log", 3000), ("two.log", 10), ("blank.log", 0)):
        texts = [f"{name} {i}" for i in range(n)]
        body = "".join(t + ("\n\n" if i % 7 == 0 else "\r\n" if i % 7 == 1 else "\n") for i, t in enumerate(texts))
        (tmp_path / name).write_bytes(("  \n" + body).encode() + b"\xff\xfe end\n")
        expected[name] = texts + ["\ufffd\ufffd end"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits per file
    try:
        scanned = scan_lines(spark, str(tmp_path))
        assert scanned.select("block_start").distinct().count() > 5
        got = number_lines(scanned).collect()
        first = sample_lines(scanned, 5).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, texts in expected.items():
        mine = sorted((r.line_no, r.raw) for r in got if r.source_file.endswith(name))
        assert [n for n, _ in mine] == list(range(1, len(texts) + 1))
        assert [t for _, t in mine] == texts
        assert [r.raw for r in sorted(first, key=lambda r: r.sample_no) if r.source_file.endswith(name)] == texts[:5]


def test_sides_too_large_to_broadcast(spark, tmp_path, monkeypatch):
    """The same rows when neither split offsets nor file headers may be broadcast."""
    for name in ("a", "b"):
        rows = [f"2024-03-04T01:02:{i % 60:02d},{i},Error,m {i}" for i in range(300)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["TimeCreated,Id,Level,Message" if name == "a" else "Date,Event ID,Level,Message", *rows]))
    (tmp_path / "c.log").write_text("\n".join([BSD] * 50))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        def run():
            parsed = parse_corpus(number_lines(scan_lines(spark, str(tmp_path))), dense=True)
            return sorted((r.source_file, r.line_no, r.format, r.event_id, r.message) for r in parsed.collect())

        small = run()
        for module in ("emberlog.operators.joins", "emberlog.session"):
            monkeypatch.setattr(f"{module}.is_small", lambda *args: False)
        monkeypatch.setattr("emberlog.session.F.broadcast", lambda df: pytest.fail("broadcast"))
        assert run() == small and len(small) == 652
        assert sum(r[3] is not None for r in small) == 600
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_in_memory_lines(spark):
    df = spark.createDataFrame([(1, "a\n"), (2, "  "), (3, CLF + "\n")], "n int, value string")
    got = lines_from(df, "value", order="n")
    assert [r.raw for r in got.orderBy("line_no").collect()] == ["a", CLF]
    assert formats(got) == {"": "clf"}


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql("SELECT token_estimate('12345678'), token_estimate(NULL), severity_rank('LOW'), severity_rank('x'), "
                    "ioc_type('1.2.3.4'), ioc_type(r'C:\\x'), ioc_type('a@b.c'), ioc_type('abc')").first()
    assert tuple(row) == (2, 1, 3, 99, "ip", "path", "email", "string")
