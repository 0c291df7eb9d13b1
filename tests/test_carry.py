"""A log searched batch by batch gives the alerts that it gives as a whole."""

import datetime as dt
import random

import pytest

from emberlog import analyze
from emberlog.operators import detectors as det
from emberlog.sources.alert_tables import read_alerts
from emberlog.sources.lines import scan_lines
from emberlog.streaming import carry

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def ssh(sec, ip, user="root", failed=True):
    return sec, "auth", f"{at(sec):%Y-%m-%d %H:%M:%S} gate sshd[1]: {'Failed' if failed else 'Accepted'} password for {user} from {ip} port 2 ssh2"


def web(sec, ip, path="/", status=200, size=10):
    return sec, "web", f'{ip} - - [{at(sec):%d/%b/%Y:%H:%M:%S} +0000] "GET {path} HTTP/1.1" {status} {size} "-" "x"'


def incident():
    """Five days: a beacon twice a day, bursts and scans over hours, counts and transfers over all of it."""
    r, hour = random.Random(1), 3600
    rows = [web(43_200 * k + 7, "10.0.0.1") for k in range(10)]
    rows += [ssh(11 * hour + 10 * k, "10.0.0.2") for k in range(1200)]  # over three hours without a break
    rows += [ssh(12 * hour - 40 + 4 * k, "10.0.0.3") for k in range(20)] + [ssh(12 * hour + 600, "10.0.0.3", failed=False)]  # across a border
    rows += [ssh(24 * hour - 1500 + 120 * k, "10.0.0.4", f"u{k}") for k in range(20)]
    rows += [web(36 * hour - 30 + k, "10.0.0.5", f"/p{k}", 404) for k in range(60)]
    rows += [web(r.randrange(5 * 24 * hour), "10.0.0.6", f"/q?id=1%27%20OR%201%3D1&{k}") for k in range(40)]
    rows += [web(20 * hour + hour * k, "10.0.0.7", "/big", size=3 * 10**8) for k in range(12)]
    rows += [ssh(r.randrange(5 * 24 * hour), "10.0.0.8") for _ in range(9)] + [ssh(5000, "10.0.0.9"), ssh(300_000, "10.0.0.9")]
    return sorted(rows)


def write(folder, rows):
    folder.mkdir(parents=True)
    for name in {n for _, n, _ in rows}:
        (folder / f"{name}.log").write_text("\n".join(line for _, n, line in rows if n == name) + "\n")
    return str(folder)


def shown(alerts, ids=True):
    return {(a.severity, a.title, a.description, a.timestamp_first, a.timestamp_last, tuple(a.affected_lines)) + ((a.id,) if ids else ()) for a in alerts.collect()}


@pytest.mark.parametrize("hours, whole", [(24, 2)])
def test_batches_find_what_the_whole_log_holds(spark, tmp_path, monkeypatch, hours, whole):
    monkeypatch.setattr(carry, "WHOLE", whole)
    rows, out = incident(), str(tmp_path / "out")
    for k in range(5 * 24 // hours):
        part = [x for x in rows if hours * 3600 * k <= x[0] < hours * 3600 * (k + 1)]
        for _ in range(2 if k == 3 else 1):  # a batch run again changes nothing
            carry.search_lines(scan_lines(spark, write(tmp_path / f"part{k}-{_}", part)), out, k)
    got = shown(read_alerts(spark, out))
    want = shown(analyze(spark, write(tmp_path / "all", rows), str(tmp_path / "one"), "INFO", detect=carry.search_all))
    pick = lambda alerts, *titles: {a for a in alerts if a[1].startswith(titles)}
    assert {a[1] for a in pick(want, "Regular", "Brute", "Credential", "Scan", "SQL", "Large", "Login")} == {
        *(f"Regular beacon from 10.0.0.{k}" for k in (1, 2, 4, 7)), "Brute force from 10.0.0.2", "Brute force from 10.0.0.3", "Credential stuffing from 10.0.0.4", "Scan from 10.0.0.5",
        "SQL injection attempts from 10.0.0.6", "Large outbound transfer to 10.0.0.7", "Login after failures from 10.0.0.3"}
    exact = lambda alerts: {a for a in alerts if not a[1].startswith(("Regular", "Large"))}
    # lower bands that an earlier batch gave to sources that are bursts later on stay
    late = {a for a in exact(got) - exact(want) if a[1].startswith("Failed logins")}
    assert exact(got) - late == exact(want)
    # of these the evidence begins in the batch that completes them
    apart = lambda alerts: {a[:5] + a[6:] for a in alerts if a[1].startswith(("Regular", "Large"))}
    assert apart(got) == apart(want)
    assert len([b for b in (tmp_path / "out" / "state").rglob("batch_id=*")]) == 5


def test_state_is_bounded(spark, tmp_path, monkeypatch):
    """Closed runs and old spans leave the table when it is written whole; sums of gaps stay."""
    monkeypatch.setattr(carry, "WHOLE", 2)
    out = str(tmp_path / "out")
    for k in range(5):
        rows = [ssh(4 * 86_400 * k + 2 * i, f"10.0.1.{k}") for i in range(15)]
        carry.search_lines(scan_lines(spark, write(tmp_path / str(k), rows)), out, k)
    state = carry.read_state(spark, out, 5).collect()
    runs = {s.subject for s in state if s.category == "brute_force"}
    assert runs == {"10.0.1.4"} and {s.subject for s in state if s.category == "gaps"} == {f"10.0.1.{k}" for k in range(5)}
    assert {s.slot for s in state if s.search == carry._SPANS} == {4}


def test_lines_without_a_time_and_empty_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = ["no time at all, sudo: nothing\n", "\n\n", "\n".join(line for _, _, line in [ssh(k, "10.0.0.1") for k in range(12)]) + "\n"]
    for k, text in enumerate(batches):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.log").write_text(text)
        carry.search_lines(scan_lines(spark, str(tmp_path / str(k))), out, k, "syslog")
    assert [a.title for a in read_alerts(spark, out).collect()] == ["Brute force from 10.0.0.1"]


def test_gap_sums_add_up(spark):
    r = random.Random(3)
    rows = [(ip, r.randrange(10**6)) for ip in "ab" for _ in range(200)]
    seconds = spark.createDataFrame(rows, "source_ip string, sec long")
    whole = det.gap_moments(carry.gap_sums(seconds, ["source_ip"])).collect()
    for x in whole:
        s = sorted({t for ip, t in rows if ip == x.source_ip})
        gaps = [b - a for a, b in zip(s, s[1:])]
        assert x.gaps == len(gaps) and abs(x.mean_gap - sum(gaps) / len(gaps)) < 1e-6
