"""Sliding distinct counts, hidden periods and unusual windows, against plain loops."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from emberlog.operators import detectors as det
from emberlog.operators import slices

TAGGED = ("source_ip string, sec long, target string, answered int, sent long, login_failed boolean, login_user string, rules array<string>, origin string")


def tagged(spark, rows):
    """rows: (source_ip, sec, target, answered, sent, login_user); a login_user failed to log in."""
    return spark.createDataFrame([(ip, sec, target, status, sent, user is not None, user, [], ip) for ip, sec, target, status, sent, user in rows], TAGGED)


def runs(seconds, gap):
    """(first, last, most) of hot seconds {sec: (n, since)} less than ``gap`` apart; they begin with the first one's window."""
    out, last = [], None
    for s in sorted(seconds):
        n, since = seconds[s]
        if last is not None and s - last < gap:
            out[-1] = (min(out[-1][0], since), s, max(out[-1][2], n))
        else:
            out.append((since, s, n))
        last = s
    return out


@pytest.mark.parametrize("seed, window, span", [(1, 30, 400), (2, 100, 300_000), (3, 90_000, 400_000)])
def test_distinct_values_in_every_window(spark, seed, window, span):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randrange(span), r.choice([*"uvwxyz", None])) for _ in range(500)]
    got = slices.distinct_trailing(spark.createDataFrame(rows, "k string, sec long, v string"), ["k"], "v", window, "n")
    inside = lambda k, s: [(t, v) for j, t, v in rows if j == k and v and s - window <= t <= s]
    want = {(k, s, len({v for _, v in inside(k, s)}), min(inside(k, s))[0]) for k, s, v in rows if v}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_following(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(200)) for k in "ab" for _ in range(150)] + [("c", 7)]
    got = {(x.k, x.sec): x.later for x in slices.following(spark.createDataFrame(rows, "k string, sec long"), ["k"], 3, block=4).collect()}
    seconds = {k: sorted({s for j, s in rows if j == k}) for k in "abc"}
    assert got == {(k, s): seconds[k][i + 1:i + 4] for k in "abc" for i, s in enumerate(seconds[k])}


def test_a_scan_over_a_border(spark):
    """19 targets before a full hour and 19 after it are a scan that fixed windows do not see."""
    rows = [("9.9.9.9", 7200 + d, f"/{i}", 200, None, None) for i, d in enumerate([*range(-19, 0), *range(19)])]
    rows += [("8.8.8.8", 7200 * k, f"/{k}", 404, None, None) for k in range(60)]  # too slow for one
    rows += [("7.7.7.7", 50_000 + k // 2, "/same", 404, None, None) for k in range(25)]  # missing pages
    parsed = tagged(spark, rows)
    assert det.scan(parsed.filter("source_ip = '9.9.9.9'"), min_missing=100).count() == 0
    got = {(f.subject, f.first_sec, f.last_sec, f.n) for f in det.sliding_scan(parsed).collect()}
    assert got == {("9.9.9.9", 7181, 7218, 38), ("7.7.7.7", 50_000, 50_012, 25)}


@pytest.mark.parametrize("seed", range(3))
def test_scans_and_stuffing_against_loops(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["1.1.1.1", "2.2.2.2"]), r.randrange(3000), f"/{r.randrange(9)}", r.choice([200, 404]), None, r.choice([None, *"abcdef"])) for _ in range(400)]

    def hot(ip, seen, least):
        values = [(x[1], seen(x)) for x in rows if x[0] == ip and seen(x) is not None]
        inside = {s: [(t, v) for t, v in values if s - 60 <= t <= s] for s, _ in values}
        return {s: (n, min(seen)[0]) for s, seen in inside.items() if (n := len({v for _, v in seen})) >= least}

    def missing(ip):
        at = [x[1] for x in rows if x[0] == ip and x[3] == 404]
        return {s: (len(seen), min(seen)) for s in at if len(seen := [t for t in at if s - 60 <= t <= s]) >= 7}

    def both(a, b):
        none = (0, 10**9)
        return {s: (max(a.get(s, none)[0], b.get(s, none)[0]), min(a.get(s, none)[1], b.get(s, none)[1])) for s in a.keys() | b.keys()}

    ips = ("1.1.1.1", "2.2.2.2")
    got = {(f.subject, f.first_sec, f.last_sec, f.n) for f in det.sliding_scan(tagged(spark, rows), 60, 6, 7).collect()}
    assert got == {(ip, *run) for ip in ips for run in runs(both(hot(ip, lambda x: x[2], 6), missing(ip)), 60)}
    got = {(f.subject, f.first_sec, f.last_sec, f.n) for f in det.sliding_stuffing(tagged(spark, rows), 60, 4).collect()}
    assert got == {(ip, *run) for ip in ips for run in runs(hot(ip, lambda x: x[5], 4), 60)}


def test_planted_periods_are_found_and_random_visits_are_not(spark):
    r = random.Random(11)
    visit = lambda ip, sec, target="/t": (ip, int(sec), target, 200, None, None)
    rows = [visit("clean", 43_200 * k) for k in range(12)]  # twice a day
    rows += [visit("noisy", 600 * k + r.randrange(-6, 7)) for k in range(200) if r.random() > 0.2]  # missed beats and jitter
    rows += [visit("noisy", r.randrange(120_000)) for _ in range(100)]  # amid other visits to the same target
    rows += [visit("noisy", r.randrange(120_000), "/other") for _ in range(300)]
    rows += [visit("poisson", r.randrange(400_000)) for _ in range(800)]
    rows += [visit("flood", k) for k in range(300)] + [visit("few", 1000 * k) for k in range(5)]
    rows += [visit("daytime", 86_400 * d + 32_400 + r.randrange(28_800)) for d in range(30) for _ in range(20)]
    got = {f.subject: f.n for f in det.periodic_contact(tagged(spark, rows)).collect()}
    assert set(got) == {"clean", "noisy"} and got["clean"] == 43_200 and abs(got["noisy"] - 600) < 40


def test_bins_are_whole_and_in_order(spark):
    gaps = spark.range(1, 5000).select(F.col("id"), det._bin(F.col("id")).alias("bin"))
    rows = gaps.select("id", "bin", det._bin_start(F.col("bin")).alias("a"), det._bin_start(F.col("bin") + 1).alias("b")).orderBy("id").collect()
    assert all(x.a <= x.id < x.b for x in rows) and [x.bin for x in rows] == sorted(x.bin for x in rows)


def test_transfers_out_of_habit(spark):
    r, day = random.Random(2), 86_400
    rows = [("usual", day * d + r.randrange(day), None, 200, r.randrange(8, 12) * 10**6, None) for d in range(30)]
    rows += [("spike", day * d + 5, None, 200, r.randrange(8, 12) * 10**6 if d != 20 else 60 * 10**6, None) for d in range(30)]
    rows += [("new", day * 29 + k, None, 200, 10**8, None) for k in range(3)]
    rows += [("small", day * d, None, 200, 10 if d != 20 else 10**5, None) for d in range(30)]
    got = [(f.subject, f.first_sec // day, f.n) for f in det.unusual_transfer(tagged(spark, rows)).collect()]
    assert got == [("spike", 20, 60 * 10**6)]

    def scores(ip):
        by = {}
        for x in rows:
            if x[0] == ip:
                by[x[1] // day] = by.get(x[1] // day, 0) + x[4]
        for d in by:
            before = [by[e] for e in by if d - 14 <= e < d]
            if len(before) >= 5:
                m = median(before)
                yield d, (by[d] - m) / max(median(abs(b - m) for b in before) * 1.4826, m * 0.1, 1.0)

    low = {(f.subject, f.first_sec // day) for f in det.unusual_transfer(tagged(spark, rows), min_score=0.5, min_bytes=1).collect()}
    assert low == {(ip, d) for ip in ("usual", "spike", "new", "small") for d, z in scores(ip) if z >= 0.5}
