"""Threat detectors over the rendered corpora; the SQL works on event columns only."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import detectors as det
from emberlog.operators import rules
from emberlog.operators.parse import parse_lines
from emberlog.plans import fixtures as fx
from emberlog.plans.analyze import analyze_lines
from emberlog.plans.queries import EVENTS_SQL, query
from emberlog.session import materialize, scratch_path
from emberlog.sources.alert_tables import read_alerts
from emberlog.sources.lines import scan_lines
from emberlog.streaming.carry import RUN, Search
from emberlog.streaming.watch import watch

DAY = 86_400


def _bsd(spark, sf_dir):
    return parse_lines(fx.bsd(spark, sf_dir), "syslog", base_year=2024)


def _clf(spark, sf_dir):
    return parse_lines(fx.clf(spark, sf_dir), "clf")


def _admin(spark, sf_dir):
    return parse_lines(fx.admin(spark, sf_dir), "syslog")


def _json(spark, sf_dir):
    return parse_lines(fx.json_lines(spark, sf_dir), "json")


_WINDOWED = f"""WITH {EVENTS_SQL},
s AS (SELECT ip, sec, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS ok
      FROM e GROUP BY ip, sec),
w AS (SELECT ip, sec, sum(failed) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS c
      FROM s WHERE failed > 0)
"""


@query(_WINDOWED + f""",
h AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY ip ORDER BY sec) < {DAY} THEN 0 ELSE 1 END AS step FROM w WHERE c >= 3),
r AS (SELECT *, sum(step) OVER (PARTITION BY ip ORDER BY sec) AS run FROM h)
SELECT 'brute_force' AS category, 'HIGH' AS severity, ip AS subject, min(sec) AS first_sec, max(sec) AS last_sec,
       CAST(max(c) AS BIGINT) AS n FROM r GROUP BY ip, run""")
def detect_brute_force(spark, sf_dir):
    return det.brute_force(_bsd(spark, sf_dir), DAY, 3)


_BURSTS = _WINDOWED + f""",
h AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY ip ORDER BY sec) < {DAY} THEN 0 ELSE 1 END AS step FROM w WHERE c >= 3),
r AS (SELECT *, sum(step) OVER (PARTITION BY ip ORDER BY sec) AS run FROM h)
SELECT 'Brute force from ' || ip AS title, ip AS subject, min(sec) AS first_sec, max(sec) AS last_sec, CAST(max(c) AS BIGINT) AS n FROM r GROUP BY ip, run"""


def _bursts(parsed):
    return det.brute_force(parsed, DAY, 3)


#: The windows of the search reach back a day; a burst may be as long as it likes.
_BURSTS_WATCHED = (Search(_bursts, RUN, DAY),)


def _stored(spark, out):
    return read_alerts(spark, out).select(
        "title", F.element_at("iocs", 1).alias("subject"), F.unix_seconds("timestamp_first").alias("first_sec"),
        F.unix_seconds("timestamp_last").alias("last_sec"), F.regexp_extract("description", r"\((\d+)\)$", 1).cast("bigint").alias("n"))


def _write_lines(lines, folder, part):
    lines.filter(part).select("raw").write.mode("append").text(folder)


@query(_BURSTS)
def analyze_two_runs(spark, sf_dir):
    """The log of every other user, then that of the rest, analysed into one store, which keeps the alerts of both runs."""
    lines, out = fx.bsd(spark, sf_dir), scratch_path(spark, "store")
    odd = F.pmod(F.regexp_extract("raw", r"from 10\.\d+\.\d+\.(\d+) ", 1).cast("int"), F.lit(2))
    for half in (0, 1):
        folder = scratch_path(spark, f"run-{half}")
        _write_lines(lines, folder, odd == half)
        analyze_lines(scan_lines(spark, folder), out, fmt="syslog", detect=_bursts, base_year=2024)
    return _stored(spark, out)


@query(_BURSTS)
def watch_split_log(spark, sf_dir):
    """One log watched as three segments, one micro-batch each: bursts over two segments come out as they are in one log."""
    lines, folder, out = fx.bsd(spark, sf_dir), scratch_path(spark, "segments"), scratch_path(spark, "store")
    ends = [None, *(F.lit(t).cast("timestamp") for t in ("2024-01-11 12:00:00", "2024-01-21 07:00:00")), None]
    timed = parse_lines(lines, "syslog", base_year=2024).select("raw", "event_ts")
    for k in range(3):
        part = F.lit(True)
        part = part if ends[k] is None else part & (F.col("event_ts") >= ends[k])
        part = part if ends[k + 1] is None else part & (F.col("event_ts") < ends[k + 1])
        _write_lines(timed, folder, part)
        watch(spark, folder, out, f"{out}-checkpoint", fmt="syslog", available_now=True, searches=_BURSTS_WATCHED, base_year=2024).awaitTermination()
    return _stored(spark, out)


@query(_WINDOWED + """
SELECT 'failed_login' AS category, CASE WHEN max(c) >= 4 THEN 'HIGH' WHEN max(c) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       ip AS subject, min(sec) AS first_sec, max(sec) AS last_sec, CAST(max(c) AS BIGINT) AS n FROM w GROUP BY ip""")
def detect_failure_bands(spark, sf_dir):
    return det.failure_bands(_bsd(spark, sf_dir), DAY, high=4, medium=2)


@query(f"""WITH {EVENTS_SQL}
SELECT 'credential_stuffing' AS category, 'HIGH' AS severity, ip AS subject, min(sec) AS first_sec, max(sec) AS last_sec,
       count(DISTINCT event_id % 5) AS n FROM e WHERE event_type = 'error'
GROUP BY ip, sec // {5 * DAY} HAVING count(DISTINCT event_id % 5) >= 3""")
def detect_credential_stuffing(spark, sf_dir):
    return det.credential_stuffing(_bsd(spark, sf_dir), 5 * DAY, 3)


@query(_WINDOWED + """,
p AS (SELECT ip, sec, ok,
        sum(failed) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS n,
        min(CASE WHEN failed > 0 THEN sec END) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS since
      FROM s)
SELECT 'success_after_failures' AS category, 'CRITICAL' AS severity, ip AS subject, since AS first_sec, sec AS last_sec,
       CAST(n AS BIGINT) AS n FROM p WHERE ok > 0 AND n >= 1""")
def detect_success_after_failures(spark, sf_dir):
    return det.success_after_failures(_bsd(spark, sf_dir))


# every 97th access line has no address; its findings are kept under the file
_ORIGIN = "CASE WHEN event_id % 97 = 0 THEN 'clf.log' ELSE ip END"


def _request_sql(category: str, severity: str, where: str) -> str:
    return f"""WITH {EVENTS_SQL}
SELECT '{category}' AS category, {severity} AS severity, {_ORIGIN} AS subject, min(sec) AS first_sec, max(sec) AS last_sec,
       count(*) AS n FROM e WHERE {where} GROUP BY {_ORIGIN}"""


@query(_request_sql("sql_injection", "'HIGH'", "event_id % 10 = 0"))
def detect_sqli(spark, sf_dir):
    return det.request_attacks(_clf(spark, sf_dir), ["sql_injection"])


@query(_request_sql("xss", "'HIGH'", "event_id % 10 = 2"))
def detect_xss(spark, sf_dir):
    return det.request_attacks(_clf(spark, sf_dir), ["xss"])


@query(_request_sql("path_traversal", "'HIGH'", "event_id % 10 = 1"))
def detect_path_traversal(spark, sf_dir):
    return det.request_attacks(_clf(spark, sf_dir), ["path_traversal"])


@query(_request_sql(
    "command_injection",
    "CASE WHEN bool_or(event_type IN ('view', 'purchase')) THEN 'CRITICAL' ELSE 'HIGH' END", "event_id % 10 = 3"))
def detect_command_injection(spark, sf_dir):
    """Answered with a 2xx status (views and purchases): CRITICAL."""
    return det.request_attacks(_clf(spark, sf_dir), ["command_injection"])


@query(_request_sql("suspicious_agent", "'MEDIUM'", "event_id % 4 = 1"))
def detect_suspicious_agent(spark, sf_dir):
    return det.request_attacks(_clf(spark, sf_dir), ["suspicious_agent"])


@query(f"""WITH {EVENTS_SQL},
g AS (SELECT ip, min(sec) AS first_sec, max(sec) AS last_sec, count(*) FILTER (event_type = 'click') AS missing,
  count(DISTINCT CASE event_id % 10 WHEN 5 THEN '-' WHEN 4 THEN 'GET ' || (event_id % 50) ELSE CAST(event_id % 50 AS VARCHAR) END) AS targets
  FROM e WHERE event_id % 97 <> 0 GROUP BY ip, sec // {5 * DAY})
SELECT 'scan' AS category, 'HIGH' AS severity, ip AS subject, first_sec, last_sec, greatest(targets, missing) AS n
FROM g WHERE targets >= 12 OR missing >= 5""")
def detect_scan(spark, sf_dir):
    return det.scan(_clf(spark, sf_dir), 5 * DAY, min_targets=12, min_missing=5)


@query(f"""WITH {EVENTS_SQL},
g AS (SELECT ip, min(sec) AS first_sec, max(sec) AS last_sec, sum(CAST(round(value * 100) AS BIGINT)) AS n
  FROM e WHERE event_id % 97 <> 0 AND event_id % 11 <> 0 GROUP BY ip, sec // {DAY})
SELECT 'exfiltration' AS category, 'HIGH' AS severity, ip AS subject, first_sec, last_sec, CAST(n AS BIGINT) AS n
FROM g WHERE n >= 20000""")
def detect_exfiltration(spark, sf_dir):
    return det.exfiltration(_clf(spark, sf_dir), 20_000)


@query(f"""WITH {EVENTS_SQL}
SELECT 'privilege_escalation' AS category, 'HIGH' AS severity, 'u' || user_id AS subject, min(sec) AS first_sec,
       max(sec) AS last_sec, count(*) AS n FROM e WHERE event_type IN ('purchase', 'error') GROUP BY user_id HAVING count(*) >= 20""")
def detect_privilege_escalation(spark, sf_dir):
    return det.privilege_escalation(_admin(spark, sf_dir), 20)


@query(f"""WITH {EVENTS_SQL}
SELECT 'account_change' AS category, CASE WHEN bool_or(event_type = 'signup' AND event_id % 50 = 0) THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
       'u' || user_id AS subject, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS n
FROM e WHERE event_type IN ('signup', 'view') GROUP BY user_id""")
def detect_account_change(spark, sf_dir):
    return det.account_change(_admin(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL},
p AS (SELECT ip AS src, event_id % 20 AS dst, sec FROM e WHERE event_id % 6 = 3),
n AS (SELECT src, dst, min(sec) AS first_sec, max(sec) AS last_sec FROM p WHERE sec >= epoch(TIMESTAMP '2024-01-15')
      AND (src, dst) NOT IN (SELECT (src, dst) FROM p WHERE sec < epoch(TIMESTAMP '2024-01-15')) GROUP BY src, dst)
SELECT 'lateral_movement' AS category, 'MEDIUM' AS severity, src AS subject, min(first_sec) AS first_sec,
       max(last_sec) AS last_sec, count(*) AS n FROM n GROUP BY src""")
def detect_lateral_movement(spark, sf_dir):
    """Pairs seen from 15 January on that were not seen before."""
    pairs = det.connection_pairs(_json(spark, sf_dir))
    cut = F.unix_seconds(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return det.lateral_movement(pairs.filter(F.col("sec") >= cut), pairs.filter(F.col("sec") < cut))


@query(f"""WITH {EVENTS_SQL},
d AS (SELECT DISTINCT ip, sec FROM e),
g AS (SELECT ip, sec, sec - lag(sec) OVER (PARTITION BY ip ORDER BY sec) AS gap FROM d)
SELECT 'beacon' AS category, 'HIGH' AS severity, ip AS subject, min(sec) AS first_sec, max(sec) AS last_sec, count(gap) AS n
FROM g GROUP BY ip HAVING count(gap) >= 5 AND stddev_pop(gap) / avg(gap) < 0.9""")
def detect_beacon(spark, sf_dir):
    return det.beacon(_bsd(spark, sf_dir), 5, 0.9, min_mean_gap=0)


@query(f"""WITH {EVENTS_SQL}, c AS (
  SELECT {_ORIGIN} AS ip, CASE event_id % 10 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'path_traversal' WHEN 2 THEN 'xss' ELSE 'command_injection' END AS category,
         sec FROM e WHERE event_id % 10 < 4
  UNION ALL SELECT {_ORIGIN}, 'suspicious_agent', sec FROM e WHERE event_id % 4 = 1),
d AS (SELECT DISTINCT category, ip, ip <> 'clf.log' AS addressed FROM c)
SELECT category, ip AS subject, CASE WHEN addressed THEN 'block_ip' END AS action,
       CASE WHEN addressed THEN 'iptables -I INPUT -s ' || ip || ' -j DROP' END AS command, CASE WHEN addressed THEN true END AS reversible,
       CASE WHEN addressed THEN 'iptables -D INPUT -s ' || ip || ' -j DROP' END AS undo_command FROM d""")
def remediation_template(spark, sf_dir):
    found = det.request_attacks(_clf(spark, sf_dir))
    step = det.remediation_for(F.col("category"), F.col("subject"))
    return found.withColumn("r", step).select("category", "subject", "r.*")


@query(f"""WITH {EVENTS_SQL},
o AS (SELECT * REPLACE ({_ORIGIN} AS ip) FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY sec, event_id) AS rn FROM o WHERE event_id % 4 = 1)
SELECT ip AS subject, ip AS iocs, 'Scanner user agent from ' || ip AS title, 'clf.log' AS source_file, 'clf' AS log_format,
       least(count(*), 10) AS n_lines, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_at,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 10) AS line_nos
FROM t GROUP BY ip""")
def detector_evidence(spark, sf_dir):
    """The first ten lines behind each finding; the line numbers stand in for the raw text."""
    parsed = _clf(spark, sf_dir).withColumn("raw", F.col("line_no").cast("string"))
    parsed = materialize(det.tag(parsed, ["suspicious_agent"]).filter(F.size("rules") > 0))  # no other line can stand behind one
    found = materialize(det.request_attacks(parsed, ["suspicious_agent"]))
    found = det.with_evidence(found, det.evidence_lines(parsed, ["suspicious_agent"]))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return det.to_alerts(found).select(
        F.element_at("iocs", 1).alias("subject"), F.array_join("iocs", "|").alias("iocs"), "title", "source_file", "log_format",
        F.size("affected_lines").cast("bigint").alias("n_lines"),
        F.date_format("timestamp_first", fmt).alias("first_at"), F.date_format("timestamp_last", fmt).alias("last_at"),
        F.array_join("affected_lines", ",").alias("line_nos"))


def _runs_sql(hot: str, gap: int, category: str) -> str:
    """Runs of the hot seconds (ip, sec, n, since) of ``hot`` less than ``gap`` apart, as findings."""
    return f"""
g AS (SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY ip ORDER BY sec) < {gap} THEN 0 ELSE 1 END AS step FROM {hot}),
r AS (SELECT *, sum(step) OVER (PARTITION BY ip ORDER BY sec) AS run FROM g)
SELECT '{category}' AS category, 'HIGH' AS severity, ip AS subject, min(since) AS first_sec, max(sec) AS last_sec, CAST(max(n) AS BIGINT) AS n FROM r GROUP BY ip, run"""


@query(f"""WITH {EVENTS_SQL},
v AS (SELECT ip, sec, event_type = 'click' AS miss,
  CASE event_id % 10 WHEN 5 THEN '-' WHEN 4 THEN 'GET ' || (event_id % 50) ELSE CAST(event_id % 50 AS VARCHAR) END AS target FROM e WHERE event_id % 97 <> 0),
c AS (SELECT m.ip, m.sec, count(DISTINCT target) AS targets, count(*) FILTER (miss) AS missing, bool_or(miss AND v.sec = m.sec) AS missed,
    min(v.sec) AS since, min(v.sec) FILTER (miss) AS miss_since
  FROM (SELECT DISTINCT ip, sec FROM v) m JOIN v ON v.ip = m.ip AND v.sec BETWEEN m.sec - {3 * DAY} AND m.sec GROUP BY m.ip, m.sec),
h AS (SELECT ip, sec, greatest(CASE WHEN targets >= 11 THEN targets ELSE 0 END, CASE WHEN missed AND missing >= 5 THEN missing ELSE 0 END) AS n,
    least(CASE WHEN targets >= 11 THEN since END, CASE WHEN missed AND missing >= 5 THEN miss_since END) AS since
  FROM c WHERE targets >= 11 OR missed AND missing >= 5),""" + _runs_sql("h", 3 * DAY, "scan"))
def detect_scan_sliding(spark, sf_dir):
    """Distinct targets and missing pages in every window of three days, wherever it starts."""
    return det.sliding_scan(_clf(spark, sf_dir), 3 * DAY, min_targets=11, min_missing=5)


@query(f"""WITH {EVENTS_SQL},
v AS (SELECT ip, sec, event_id % 5 AS name FROM e WHERE event_type = 'error'),
h AS (SELECT m.ip, m.sec, count(DISTINCT name) AS n, min(v.sec) AS since FROM (SELECT DISTINCT ip, sec FROM v) m JOIN v ON v.ip = m.ip AND v.sec BETWEEN m.sec - {3 * DAY} AND m.sec
  GROUP BY m.ip, m.sec HAVING count(DISTINCT name) >= 3),""" + _runs_sql("h", 3 * DAY, "credential_stuffing"))
def detect_stuffing_sliding(spark, sf_dir):
    return det.sliding_stuffing(_bsd(spark, sf_dir), 3 * DAY, 3)


_LEADS = ", ".join(f"lead(sec, {j}) OVER w - sec" for j in range(1, 9))
_GAPS_SQL = f"""WITH {EVENTS_SQL},
d AS (SELECT DISTINCT ip, sec FROM e),
l AS (SELECT ip, unnest([{_LEADS}]) AS gap FROM d WINDOW w AS (PARTITION BY ip ORDER BY sec)),
k AS (SELECT ip, gap, len(bin(gap)) - 1 AS p FROM l WHERE gap IS NOT NULL),
h AS (SELECT ip, CAST(p * 16 + floor(gap * 16 / 2.0::DOUBLE ** p) - 16 AS INT) AS bin, count(*) AS gaps, CAST(sum(gap) AS BIGINT) AS total FROM k GROUP BY ip, 2)"""


@query(_GAPS_SQL + " SELECT ip AS source_ip, bin, gaps, total FROM h")
def beacon_gap_histogram(spark, sf_dir):
    return det.gap_histogram(_bsd(spark, sf_dir)).select("source_ip", "bin", "gaps", "total")


@query(_GAPS_SQL + """,
b AS (SELECT ip, bin, sum(gaps) AS gaps, sum(total) AS total FROM (SELECT ip, bin, gaps, total FROM h UNION ALL SELECT ip, bin - 1, gaps, total FROM h) GROUP BY ip, bin),
s AS (SELECT ip, count(*) AS visits, min(sec) AS first_sec, max(sec) AS last_sec FROM d GROUP BY ip),
w AS (SELECT *, total / gaps AS period, 2.0::DOUBLE ** floor((bin + 2) / 16.0) * (16 + (bin + 2) % 16) / 16 - 2.0::DOUBLE ** floor(bin / 16.0) * (16 + bin % 16) / 16 AS width FROM b JOIN s USING (ip)),
f AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY gaps DESC, floor(period)) AS rn FROM w
  WHERE gaps >= 8 AND period >= 30 AND gaps * period >= 0.1 * (last_sec - first_sec) AND gaps * (last_sec - first_sec) >= 1.5 * visits * visits * width)
SELECT 'periodic_contact' AS category, 'MEDIUM' AS severity, ip AS subject, first_sec, last_sec, CAST(floor(period) AS BIGINT) AS n FROM f WHERE rn = 1""")
def detect_periodic_contact(spark, sf_dir):
    """With thresholds low enough that some of the random visits of the events pass them."""
    return det.periodic_contact(_bsd(spark, sf_dir), 8, 30, 0.1, 1.5)


@query(f"""WITH {EVENTS_SQL},
s AS (SELECT ip, sec // {DAY} AS slot, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS n, min(sec) AS first_sec, max(sec) AS last_sec
  FROM e WHERE event_id % 97 <> 0 AND event_id % 11 <> 0 GROUP BY ip, 2),
h AS (SELECT *, list(n) OVER (PARTITION BY ip ORDER BY slot RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS earlier FROM s),
m AS (SELECT *, list_aggregate(earlier, 'median') AS med FROM h WHERE len(earlier) >= 5 AND n >= 1000),
a AS (SELECT *, list_aggregate(list_transform(earlier, lambda b: abs(b - med)), 'median') AS away FROM m)
SELECT 'unusual_transfer' AS category, 'MEDIUM' AS severity, ip AS subject, first_sec, last_sec, n
FROM a WHERE (n - med) / greatest(away * 1.4826::DOUBLE, med * 0.1::DOUBLE, 1.0::DOUBLE) >= 2""")
def detect_unusual_transfer(spark, sf_dir):
    return det.unusual_transfer(_clf(spark, sf_dir), min_score=2, min_bytes=1000)


assert set(rules.REQUEST_RULES) <= set(rules.RESPONSES)
