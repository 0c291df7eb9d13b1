"""Parsed fields of each format, checked against the columns the lines were rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.scalars import all_ips, first_ip
from emberlog.operators.formats import jsonl, syslog
from emberlog.operators.parse import parse_corpus, parse_lines
from emberlog.plans import fixtures as fx
from emberlog.plans.queries import EVENTS_SQL, query


def _at():
    return F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("at")


_E = f"WITH {EVENTS_SQL} "

_FACILITY = """list_element(['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp'],
  CAST((event_id % 192) // 8 + 1 AS INTEGER))"""
_LEVEL = """list_element(['EMERGENCY','ALERT','CRITICAL','ERROR','WARNING','NOTICE','INFO','DEBUG'],
  CAST((event_id % 192) % 8 + 1 AS INTEGER))"""
_USERS = "['root','admin','invalid user test','oracle','guest']"
_LOGIN = f"""CASE WHEN event_type = 'error'
  THEN 'Failed password for ' || list_element({_USERS}, CAST(event_id % 5 + 1 AS INTEGER)) || ' from ' || ip || ' port 22 ssh2'
  ELSE 'Accepted password for deploy from ' || ip || ' port 22 ssh2' END"""


@query(_E + f"""
SELECT source_file, event_id AS line_no, coalesce({_FACILITY}, CAST((event_id % 192) // 8 AS VARCHAR)) AS facility, {_LEVEL} AS level
FROM e, (VALUES ('bsd.log'), ('rfc5424.log')) v(source_file)""")
def syslog_pri_decode(spark, sf_dir):
    """Priorities of lines of both grammars, as the parser reads them."""
    pri = F.concat(F.lit("<"), (F.col("line_no") % 192).cast("string"), F.lit(">"))
    bsd = fx.bsd(spark, sf_dir).withColumn("raw", F.concat(pri, "raw"))
    lines = bsd.unionByName(fx.rfc5424(spark, sf_dir).withColumn("source_file", F.lit("rfc5424.log")))
    return parse_lines(lines, "syslog").select("source_file", "line_no", "facility", "level")


@query(_E + """
SELECT event_id AS line_no, 'syslog' AS format, 'h' || CAST(user_id % 7 AS VARCHAR) AS host,
       'app' || CAST(event_id % 5 AS VARCHAR) AS process, at_text AS at,
       'event of type ' || event_type || ' from ' || ip AS message, CAST(NULL AS VARCHAR) AS source_ip
FROM e""")
def syslog_rfc5424(spark, sf_dir):
    return parse_lines(fx.rfc5424(spark, sf_dir), "syslog").select(
        "line_no", "format", "host", "process", _at(), "message", "source_ip")


@query(_E + f"""
SELECT event_id AS line_no, 'syslog' AS format, 'web' || CAST(user_id % 3 AS VARCHAR) AS host, 'sshd' AS process,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id + 1000 AS VARCHAR) END AS pid, ip AS source_ip,
       {_LOGIN} AS message FROM e""")
def syslog_bsd(spark, sf_dir):
    return parse_lines(fx.bsd(spark, sf_dir), "syslog").select(
        "line_no", "format", "host", "process", "pid", "source_ip", "message")


@query(_E + f"""
SELECT event_id AS line_no, 'syslog' AS format, 'web' || CAST(user_id % 3 AS VARCHAR) AS host, '77' AS pid,
       at_text AS at, ip AS source_ip, {_LOGIN} AS message FROM e""")
def syslog_journald(spark, sf_dir):
    return parse_lines(fx.journald(spark, sf_dir), "syslog").select(
        "line_no", "format", "host", "pid", _at(), "source_ip", "message")


@query("""
SELECT doc_id * 1048576 + pos AS line_no, 'unknown' AS format, raw = raw AS message_is_raw,
       nullif(regexp_extract(raw, '\\b(\\d{1,3}(?:\\.\\d{1,3}){3})\\b', 1), '') AS source_ip
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
             generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
WHERE regexp_matches(raw, '\\S')""")
def parse_unknown_fallback(spark, sf_dir):
    return parse_lines(fx.document_lines(spark, sf_dir), "syslog").select(
        "line_no", "format", (F.col("message") == F.col("raw")).alias("message_is_raw"), "source_ip")


@query(_E + """
SELECT event_id AS line_no, '2000' || substr(at_text, 5) AS at FROM e""")
def bsd_timestamp(spark, sf_dir):
    """The year is not in the line: 2000 stands for it."""
    return parse_lines(fx.bsd(spark, sf_dir), "syslog").select("line_no", _at())


_QUERY = """CASE event_id % 10 WHEN 0 THEN '?q=1%27%20OR%201%3D1' WHEN 1 THEN '?f=..%2F..%2Fetc%2Fpasswd'
  WHEN 2 THEN '?q=%3Cscript%3Ealert(1)%3C%2Fscript%3E' WHEN 3 THEN '?c=1%3Bcat%20%2Ftmp%2Fx' ELSE '' END"""
_PATH = f"'/p/' || CAST(event_id % 50 AS VARCHAR) || {_QUERY}"
_VERB = "CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END"
_STATUS = "CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 404 WHEN 'signup' THEN 401 ELSE 200 END"
_METHOD = f"CASE WHEN event_id % 10 IN (4, 5) THEN NULL ELSE {_VERB} END"
_WHOLE = f"CASE event_id % 10 WHEN 4 THEN 'GET ' || {_PATH} WHEN 5 THEN '-' ELSE {_PATH} END"
_CLF_LEVEL = f"CASE WHEN {_STATUS} >= 500 THEN 'ERROR' WHEN {_STATUS} >= 400 THEN 'WARNING' ELSE 'INFO' END"


@query(_E + f"""
SELECT event_id AS line_no, 'clf' AS format, CASE WHEN event_id % 97 = 0 THEN NULL ELSE ip END AS source_ip,
       CASE WHEN event_id % 3 = 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS auth_user,
       CAST({_STATUS} AS INTEGER) AS status_code,
       CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS bytes_sent,
       CASE WHEN event_id % 4 = 3 THEN 'http://example.com/r' END AS referer,
       CASE event_id % 4 WHEN 1 THEN 'sqlmap/1.7' WHEN 3 THEN 'Mozilla/5.0 (X11)' END AS user_agent,
       CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END
            + CASE event_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END + 4 AS BIGINT) AS n_extra
FROM e""")
def clf_parse(spark, sf_dir):
    return parse_lines(fx.clf(spark, sf_dir), "clf").select(
        "line_no", "format", "source_ip", "auth_user", "status_code", "bytes_sent", "referer", "user_agent",
        F.size("extra").cast("bigint").alias("n_extra"))


@query(_E + f"SELECT event_id AS line_no, {_METHOD} AS method, {_WHOLE} AS path FROM e")
def clf_request_split(spark, sf_dir):
    return parse_lines(fx.clf(spark, sf_dir), "clf").select("line_no", "method", "path")


@query(_E + f"SELECT event_id AS line_no, {_CLF_LEVEL} AS level FROM e")
def clf_status_level(spark, sf_dir):
    return parse_lines(fx.clf(spark, sf_dir), "clf").select("line_no", "level")


@query(_E + f"""
SELECT event_id AS line_no,
       coalesce({_METHOD}, '?') || ' ' || {_WHOLE} || ' → ' || CAST({_STATUS} AS VARCHAR) AS message FROM e""")
def clf_message(spark, sf_dir):
    return parse_lines(fx.clf(spark, sf_dir), "clf").select("line_no", "message")


@query(_E + "SELECT event_id AS line_no, at_text AS at FROM e")
def clf_timestamp(spark, sf_dir):
    """Both zones come out as the same instant."""
    return parse_lines(fx.clf(spark, sf_dir), "clf").select("line_no", _at())


_JLEVEL = """list_element(['CRITICAL','ERROR','WARNING','INFO','DEBUG','NOTICE'],
  CAST((event_id // 6) % 6 + 1 AS INTEGER))"""
_JTEXT = "'event ' || CAST(event_id AS VARCHAR) || ' by ' || ip"


def _objects(spark, sf_dir):
    return parse_lines(fx.json_lines(spark, sf_dir), "json").filter("format = 'json'")


@query(_E + """
SELECT event_id AS line_no, event_id % 6 IN (0, 2, 3) AS has_time, event_id % 6 IN (0, 2, 3) AS has_level,
       CASE event_id % 6 WHEN 0 THEN ip WHEN 2 THEN ip WHEN 3 THEN '' END AS ip_field,
       CASE event_id % 6 WHEN 0 THEN 'h1' WHEN 3 THEN 'n7' END AS host
FROM e WHERE event_id % 6 < 4""")
def json_alias_resolve(spark, sf_dir):
    """A key that is present wins even when its value is null (shape 1 has a null ``timestamp`` before ``time``)."""
    m = F.col("m")
    rows = fx.json_lines(spark, sf_dir).withColumn("m", jsonl.fields(F.col("raw"))).filter("m IS NOT NULL")
    return rows.select(
        "line_no",
        jsonl.alias_value(m, jsonl.TIME_KEYS).isNotNull().alias("has_time"),
        jsonl.alias_value(m, jsonl.LEVEL_KEYS).isNotNull().alias("has_level"),
        jsonl.alias_value(m, jsonl.IP_KEYS).alias("ip_field"),
        jsonl.alias_value(m, jsonl.HOST_KEYS).alias("host"))


@query(_E + f"""
SELECT event_id AS line_no,
       CASE event_id % 6 WHEN 0 THEN 'm' || CAST(event_id AS VARCHAR) WHEN 2 THEN 'raw' ELSE {_JTEXT} END AS message
FROM e WHERE event_id % 6 < 4""")
def json_message_default(spark, sf_dir):
    """An empty message falls back to the whole line (shown as ``raw``)."""
    whole = F.when(F.col("message") == F.col("raw"), "raw").otherwise(F.col("message"))
    return _objects(spark, sf_dir).select("line_no", whole.alias("message"))


@query(_E + """
SELECT event_id AS line_no, CASE WHEN event_id % 6 = 1 THEN NULL ELSE at_text END AS at
FROM e WHERE event_id % 6 < 4""")
def json_ts_variants(spark, sf_dir):
    """Fractions and offsets are dropped, not applied."""
    return _objects(spark, sf_dir).select("line_no", _at())


@query(_E + f"""
SELECT event_id AS line_no, CASE WHEN event_id % 6 = 1 THEN NULL ELSE {_JLEVEL} END AS level
FROM e WHERE event_id % 6 < 4""")
def json_level_norm(spark, sf_dir):
    return _objects(spark, sf_dir).select("line_no", "level")


@query(_E + "SELECT event_id AS line_no, ip AS source_ip FROM e WHERE event_id % 6 < 4")
def json_ip_fallback(spark, sf_dir):
    """From a field, or from the message where the field is absent or empty."""
    return _objects(spark, sf_dir).select("line_no", "source_ip")


@query(_E + """
SELECT event_id AS line_no,
       CASE event_id % 6 WHEN 0 THEN 'request_id=' || CAST(event_id AS VARCHAR)
            WHEN 3 THEN 'dst_ip=192.168.0.' || CAST(event_id % 20 AS VARCHAR) || ';nested={"k":' || CAST(event_id AS VARCHAR) || '}'
            ELSE '' END AS extra
FROM e WHERE event_id % 6 < 4""")
def json_extra_keys(spark, sf_dir):
    pairs = F.transform(F.array_sort(F.map_entries("extra")), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return _objects(spark, sf_dir).select("line_no", F.array_join(pairs, ";").alias("extra"))


@query(_E + """
SELECT event_id AS line_no, CASE WHEN event_id % 6 < 4 THEN 'json' ELSE 'unknown' END AS format,
       CASE WHEN event_id % 6 < 4 THEN ip END AS source_ip
FROM e""")
def json_parse_all(spark, sf_dir):
    """Lines that are not one object are kept as unknown, without a search for addresses."""
    return parse_lines(fx.json_lines(spark, sf_dir), "json").select("line_no", "format", "source_ip")


@query(r"""
SELECT doc_id, nullif(regexp_extract(text, '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 1), '') AS first_ip,
       array_to_string(regexp_extract_all(text, '\b(\d{1,3}(?:\.\d{1,3}){3})\b', 1), ',') AS ips
FROM documents""")
def extract_ips(spark, sf_dir):
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", first_ip(text).alias("first_ip"), F.array_join(all_ips(text), ",").alias("ips"))


_GOOD = "FROM e WHERE event_id % 20 <> 0"
_ODD = "user_id % 2 = 1"


def _csv_rows(spark, sf_dir):
    parsed = parse_corpus(fx.windows_csv(spark, sf_dir), "windows_csv")
    return parsed.filter("format = 'windows_csv' AND line_no >= 0")


@query(_E + f"""
SELECT event_id AS line_no,
       CASE WHEN {_ODD} THEN 'plain message ' || CAST(event_id AS VARCHAR)
            ELSE 'logon "' || event_type || '" from ' || ip || ', id ' || CAST(event_id AS VARCHAR) END AS message,
       CASE WHEN {_ODD} THEN NULL ELSE ip END AS source_ip
{_GOOD}""")
def wincsv_parse(spark, sf_dir):
    return _csv_rows(spark, sf_dir).select("line_no", "message", "source_ip")


@query(_E + f"""
SELECT event_id AS line_no, CASE WHEN {_ODD} THEN 'SRV2' ELSE 'PC1' END AS host,
       CASE WHEN {_ODD} THEN NULL ELSE 'Security' END AS facility, CAST(event_id AS VARCHAR) AS event_id,
       CASE WHEN {_ODD} THEN 'None' ELSE 'Logon' END AS task_category,
       CASE WHEN {_ODD} THEN 'DOM\\u' || CAST(user_id AS VARCHAR) END AS account_name
{_GOOD}""")
def wincsv_columns(spark, sf_dir):
    return _csv_rows(spark, sf_dir).select(
        "line_no", "host", "facility", "event_id", "task_category", "account_name")


@query(_E + f"SELECT event_id AS line_no, at_text AS at {_GOOD}")
def wincsv_ts_variants(spark, sf_dir):
    return _csv_rows(spark, sf_dir).select("line_no", _at())


@query(_E + f"""
SELECT event_id AS line_no, CASE WHEN {_ODD} THEN 'DEBUG' WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level
{_GOOD}""")
def wincsv_level_norm(spark, sf_dir):
    return _csv_rows(spark, sf_dir).select("line_no", "level")


@query(_E + f"""
SELECT event_id AS line_no,
       CASE WHEN {_ODD} THEN 'account_name,event_id,task_category'
            WHEN event_id % 2 = 0 THEN 'event_id,task_category' ELSE 'Keywords,event_id,task_category' END AS keys
{_GOOD}""")
def wincsv_extra(spark, sf_dir):
    return _csv_rows(spark, sf_dir).select(
        "line_no", F.array_join(F.sort_array(F.map_keys("extra")), ",").alias("keys"))
