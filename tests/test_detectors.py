"""Detectors on a small incident, from files to stored alerts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog import analyze, number_lines, parse_corpus, parse_lines, scan_lines
from emberlog.operators import detectors as det
from emberlog.operators.alerts import by_ioc, by_severity
from emberlog.sources.alert_tables import compact, read_alerts, read_current, read_iocs


def incident() -> list[str]:
    out = ["Feb  2 10:00:00 gate sshd[1]: Accepted publickey for ops from 10.0.0.5 port 1 ssh2"]
    names = ["root", "admin", "invalid user bob", "pi", "test", "git"]
    out += [f"Feb  2 10:05:{i:02d} gate sshd[2]: Failed password for {names[i % 6]} from 198.51.100.9 port 2 ssh2" for i in range(12)]
    out += ["Feb  2 10:06:30 gate sshd[3]: Accepted password for pi from 198.51.100.9 port 3 ssh2",
            "Feb  2 10:07:00 gate sudo[4]: pi : TTY=pts/0 ; PWD=/home/pi ; USER=root ; COMMAND=/bin/sh",
            "Feb  2 10:07:01 gate sudo[4]: pam_unix(sudo:auth): authentication failure; logname=pi uid=1001",
            "Feb  2 10:08:00 gate useradd[5]: new user: name=ghost, UID=0, GID=0, home=/root, shell=/bin/sh",
            "Feb  2 10:09:00 gate usermod[6]: change user 'eve' GID from '1' to '0'",
            "Feb  2 10:10:00 gate sshd[7]: Failed password for ops from 10.0.0.5 port 4 ssh2"]
    return out


def test_incident(spark, tmp_path):
    (tmp_path / "auth.log").write_text("\n".join(incident()) + "\n")
    out = str(tmp_path / "out")
    alerts = analyze(spark, str(tmp_path / "auth.log"), out, "INFO").collect()
    assert {(a.severity, a.title) for a in alerts} == {
        ("HIGH", "Brute force from 198.51.100.9"), ("HIGH", "Credential stuffing from 198.51.100.9"),
        ("CRITICAL", "Login after failures from 198.51.100.9"), ("HIGH", "Privilege escalation by pi"),
        ("CRITICAL", "Account change for ghost"), ("HIGH", "Account change for eve"), ("LOW", "Failed logins from 10.0.0.5")}
    brute = next(a for a in alerts if a.title.startswith("Brute"))
    assert brute.iocs == ["198.51.100.9"] and len(brute.affected_lines) >= 1 and brute.log_format == "syslog"
    assert brute.source_file.endswith("auth.log") and brute.remediation.command == "iptables -I INPUT -s 198.51.100.9 -j DROP"
    stuffing = next(a for a in alerts if a.title.startswith("Credential"))
    assert stuffing.affected_lines == incident()[1:11] and stuffing.timestamp_first == dt.datetime(2000, 2, 2, 10, 5, 0)
    assert analyze(spark, str(tmp_path / "auth.log"), out).count() == 7  # the same findings again add nothing
    assert read_alerts(spark, out).count() == 7
    assert by_ioc(read_alerts(spark, out), "198.51.100.9").count() == 3
    assert {r.value: r.alert_count for r in read_iocs(spark, out).collect()}["198.51.100.9"] == 3


def test_thresholds(spark, tmp_path):
    (tmp_path / "auth.log").write_text("\n".join(incident()))
    parsed = parse_corpus(number_lines(scan_lines(spark, str(tmp_path))))
    assert det.brute_force(parsed, 90, 13).count() == 0
    assert det.brute_force(parsed, 90, 12).first().n == 12
    assert det.brute_force(parsed, 5, 6).first().first_sec == det.brute_force(parsed, 90, 6).first().first_sec
    bands = {r.subject: (r.severity, r.n) for r in det.failure_bands(parsed).collect()}
    assert bands == {"198.51.100.9": ("HIGH", 12), "10.0.0.5": ("LOW", 1)}


def web(spark, rows):
    lines = [("w", i, f'{ip} - - [03/Mar/2024:04:{i // 60:02d}:{i % 60:02d} +0000] "GET {path} HTTP/1.1" {status} {size} "-" "{ua}"')
             for i, (ip, path, status, size, ua) in enumerate(rows)]
    return parse_corpus(spark.createDataFrame(lines, "source_file string, line_no bigint, raw string"), "clf")


def test_requests(spark):
    parsed = web(spark, [
        ("1.1.1.1", "/a?q=1%27+OR+1%3D1", 500, 1, "x"), ("1.1.1.1", "/a?c=%7Cwhoami", 404, 1, "x"),
        ("2.2.2.2", "/a?c=%24%28id%29", 204, 1, "Nikto/2"), ("2.2.2.2", "/..%2f..%2fetc/passwd", 404, 1, "x"),
        ("3.3.3.3", "/a?b=%3CScRiPt%3E", 200, 1, "x"), ("4.4.4.4", "/ok?id=1", 200, 1, "Mozilla"),
        ("5.5.5.5", "/gate.php", 200, 1, "x"), ("5.5.5.5", "/%zz", 200, 1, "x")])
    got = {(r.subject, r.category, r.severity) for r in det.request_attacks(parsed).collect()}
    assert got == {("1.1.1.1", "sql_injection", "HIGH"), ("1.1.1.1", "command_injection", "HIGH"),
                   ("2.2.2.2", "command_injection", "CRITICAL"), ("2.2.2.2", "suspicious_agent", "MEDIUM"),
                   ("2.2.2.2", "path_traversal", "HIGH"), ("3.3.3.3", "xss", "HIGH"), ("5.5.5.5", "c2_path", "HIGH")}
    assert {r.source_ip for r in det.c2_sources(parsed).collect()} == {"5.5.5.5"}


def test_scan_beacon_exfiltration(spark):
    rows = [("9.9.9.9", f"/{i}", 404, 10, "x") for i in range(25)] + [("8.8.8.8", "/big", 200, 10**9, "x")] * 2
    parsed = web(spark, rows)
    assert [(r.subject, r.n) for r in det.scan(parsed).collect()] == [("9.9.9.9", 25)]
    assert [(r.subject, r.n) for r in det.scan(parsed, approximate=True).collect()][0][0] == "9.9.9.9"
    assert [(r.subject, r.n) for r in det.exfiltration(parsed).collect()] == [("8.8.8.8", 2 * 10**9)]
    assert [(r.subject, r.n) for r in det.beacon(parsed, min_mean_gap=1).collect()] == [("9.9.9.9", 24)]
    assert det.beacon(parsed).count() == 0


def test_lateral_movement(spark):
    raw = ['{"ts":"2024-01-0%dT00:00:00","src_ip":"10.0.0.1","dst_ip":"%s","msg":"c"}' % (d, dst)
           for d, dst in ((1, "10.0.0.2"), (2, "10.0.0.2"), (2, "192.168.1.1"), (2, "8.8.8.8"))]
    raw.append('{"ts":"2024-01-02T00:00:00","msg":"from 172.16.0.9 to 10.0.0.7"}')
    df = spark.createDataFrame([("c", i, r) for i, r in enumerate(raw)], "source_file string, line_no bigint, raw string")
    pairs = det.connection_pairs(parse_corpus(df, "json"))
    assert pairs.count() == 4
    cut = int(dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc).timestamp())
    got = det.lateral_movement(pairs.filter(F.col("sec") >= cut), pairs.filter(F.col("sec") < cut)).collect()
    assert {(r.subject, r.n) for r in got} == {("10.0.0.1", 1), ("172.16.0.9", 1)}


def test_evidence_of_overlapping_findings(spark):
    """Against a plain loop: many findings of one hot subject, crossing days, with more lines per second than are kept."""
    import random

    rng = random.Random(8)
    day = 86_400
    lines = [("brute_force", rng.choice(["hot", "hot", "x"]), rng.choice([day - 2, day - 1, day, day + 5, 2 * day, 9]), i % 2 and "a" or "b", i)
             for i in range(400)]
    found = [("brute_force", s, f, f + length) for s in ("hot", "x", "none") for f in (0, day - 2, day, day + 1)
             for length in (0, 1, 10, 3 * day)]
    df = spark.createDataFrame(lines, "category string, subject string, sec bigint, source_file string, line_no bigint").withColumns(
        {"raw": F.col("line_no").cast("string"), "format": F.lit("syslog")})
    fs = spark.createDataFrame(found, "category string, subject string, first_sec bigint, last_sec bigint").withColumns(
        {"severity": F.lit("HIGH"), "n": F.lit(1)})
    rows = det.with_evidence(fs, df).collect()
    assert len(rows) == len(found) == len({r.id for r in rows})
    for r in rows:
        mine = sorted((sec, file, no) for _, subject, sec, file, no in lines if subject == r.subject and r.first_sec <= sec <= r.last_sec)
        assert (r.affected_lines or []) == [str(no) for _, _, no in mine[:10]]
        assert r.source_file == (mine[0][1] if mine else None)


def test_baseline_and_text_pairs_through_files(spark, tmp_path):
    (tmp_path / "j.log").write_text("\n".join(
        '{"ts":"2024-01-02T00:00:0%d","msg":"10.0.0.%d connected to 10.0.9.9"}' % (i, i % 2) for i in range(4)))
    known = spark.createDataFrame([("10.0.0.0", "10.0.9.9")], "src string, dst string")
    alerts = analyze(spark, str(tmp_path / "j.log"), str(tmp_path / "out"), baseline=known).collect()
    assert [(a.title, len(a.affected_lines), a.severity) for a in alerts] == [("New internal connection from 10.0.0.1", 2, "MEDIUM")]


def test_runs_keep_each_others_alerts(spark, tmp_path):
    out = str(tmp_path / "out")
    for k in (1, 2):
        (tmp_path / f"{k}.log").write_text("\n".join(line.replace("198.51.100.9", f"198.51.100.{k}") for line in incident()))
        analyze(spark, str(tmp_path / f"{k}.log"), out)
    assert {f"198.51.100.{k}" for k in (1, 2)} <= {r.value for r in read_iocs(spark, out).collect()}
    compact(spark, out)
    high = by_severity(read_current(spark, out), "HIGH")
    assert high.count() == by_severity(read_alerts(spark, out), "HIGH").count()
    plan = high._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [severity" in plan or "PartitionFilters: [isnotnull(severity" in plan or "severity#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_files_cut_otherwise_fail_the_job(spark, tmp_path):
    """Lines are numbered by a count per split; a read that cuts the files in other splits must not lose any."""
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(200_000)))
    numbered = number_lines(scan_lines(spark, str(tmp_path)))
    assert numbered.agg(F.countDistinct("line_no"), F.max("line_no")).first() == (200_000, 200_000)
    before = spark.conf.get("spark.sql.files.minPartitionNum")
    fresh = number_lines(scan_lines(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        with pytest.raises(Exception, match="cut differently"):
            fresh.agg(F.count("line_no")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get("spark.sql.files.minPartitionNum") == before


def attacks(path):
    bad = "/x?q=%2527%2520OR%25201%253D1"  # encoded twice
    json_lines = [f'{{"time":"2024-03-03T04:00:{i:02d}","client_ip":"198.51.100.8","path":"{bad if i == 1 else f"/p/{i}"}","status_code":{404 if i > 30 else 200},'
                  f'"user_agent":"{"sqlmap/1" if i == 2 else "x"}","bytes_sent":{10**9 if i == 3 else 5},"message":"m"}}' for i in range(60)]
    (path / "app.json").write_text("\n".join(json_lines))
    (path / "fw.log").write_text("\n".join(
        f"2024-03-03 05:00:{i:02d} fw kernel[1]: DROP IN=eth0 SRC=198.51.100.7 DST=10.0.0.1 PROTO=TCP DPT={1000 + i}" for i in range(25)))
    (path / "app.log").write_text("2024-03-03 06:00:00 web app[1]: request body <script>alert(1)</script>\n2024-03-03 06:00:01 web app[1]: fine")


def test_rules_on_every_format(spark, tmp_path):
    attacks(tmp_path)
    parsed = parse_corpus(number_lines(scan_lines(spark, str(tmp_path))))
    found = {(r.category, r.subject) for r in det.detect_all(parsed).collect()}
    assert {("sql_injection", "198.51.100.8"), ("suspicious_agent", "198.51.100.8"), ("exfiltration", "198.51.100.8"), ("scan", "198.51.100.8"),
            ("scan", "198.51.100.7"), ("xss", "web")} <= found


def test_windows_account_events(spark):
    text = "A user account was created. Subject: Account Name: admin New Account: Account Name: ghost"
    rows = parse_lines(spark.createDataFrame([("e.csv", 1, f'x,"{text}"'), ("e.csv", 2, 'x,"The audit log was cleared."')], "source_file string, line_no bigint, raw string"),
                       "windows_csv", header=["Level", "Message"])
    got = {(r.category, r.severity, r.subject) for r in det.account_change(rows).unionByName(det.clears(rows)).collect()}
    assert got == {("account_change", "HIGH", "ghost"), ("log_restart", "INFO", "e.csv")}


def test_evidence_of_lines_without_a_time(spark, tmp_path):
    (tmp_path / "a.log").write_text("no time: request /x?f=../../etc/passwd\nother")
    out = str(tmp_path / "out")
    alert = analyze(spark, str(tmp_path / "a.log"), out).first()
    assert alert.affected_lines == ["no time: request /x?f=../../etc/passwd"] and alert.source_file.endswith("a.log") and alert.timestamp_first is None
