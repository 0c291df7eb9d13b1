"""Reports on stored alerts and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions.scalars import ioc_type, register_sql_functions
from emberlog.operators import alerts as ops
from emberlog.plans import fixtures as fx
from emberlog.plans.queries import query
from emberlog.session import scratch_path
from emberlog.sources import alert_index, alert_sketches, alert_tables

_A = """WITH a AS (
  SELECT *, CAST(o_orderkey AS VARCHAR) AS id,
    list_element(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], CAST(left(o_orderpriority, 1) AS INTEGER)) AS severity,
    CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS rank,
    'Status ' || o_orderstatus || ' customer ' || o_custkey AS title,
    'Total ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' ' || o_orderpriority || ' for order ' || o_orderkey || ' ' || repeat('z', 90) AS description,
    '/var/log/f' || (o_custkey % 10) AS source_file,
    '10.' || ((o_custkey + 65536) // 65536 % 256) || '.' || (o_custkey // 256 % 256) || '.' || (o_custkey % 256) AS ip,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso
  FROM orders),
b AS (
  SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'c' || (o_custkey % 500) || '@example.com' WHEN 1 THEN '/var/log/app/' || (o_orderkey % 50)
    WHEN 2 THEN md5(CAST(o_custkey % 200 AS VARCHAR)) WHEN 3 THEN 'user' || (o_custkey % 100) ELSE ip END AS second FROM a),
c AS (
  SELECT *, CASE o_orderkey % 10 WHEN 9 THEN CAST([] AS VARCHAR[]) WHEN 8 THEN [ip, second, 'a', 'b'] ELSE [ip, second] END AS iocs FROM b)
"""
_ID = "id, severity, title, source_file"


def _alerts(spark, sf_dir):
    return fx.alerts(spark, sf_dir)


def _short(df):
    return df.select("id", "severity", "title", "source_file")


@query(_A + "SELECT count(*) AS n FROM a")
def alert_count(spark, sf_dir):
    return ops.count(_alerts(spark, sf_dir))


@query(_A + "SELECT severity, count(*) AS n FROM a GROUP BY severity")
def severity_counts(spark, sf_dir):
    return ops.severity_counts(_alerts(spark, sf_dir))


@query(_A + "SELECT severity, count(*) AS n FROM a GROUP BY severity, rank ORDER BY rank")
def severity_table(spark, sf_dir):
    return ops.severity_table(_alerts(spark, sf_dir))


@query(_A + """SELECT coalesce(source_file, '') AS source_file, coalesce(severity, '') AS severity, count(*) AS n
FROM a GROUP BY ROLLUP (source_file, severity)""")
def alert_rollup(spark, sf_dir):
    return ops.rollup(_alerts(spark, sf_dir)).na.fill("")


@query(_A + f"SELECT {_ID} FROM a WHERE rank <= 1 ORDER BY o_orderdate DESC, id")
def alerts_min_severity(spark, sf_dir):
    return _short(ops.by_severity(_alerts(spark, sf_dir), "HIGH"))


@query(_A + f"SELECT {_ID} FROM a")
def alerts_unknown_severity(spark, sf_dir):
    """An unknown name filters nothing."""
    return _short(ops.at_least(_alerts(spark, sf_dir), "NONE"))


@query(_A + f"""SELECT {_ID} FROM c
WHERE contains(lower(title), 'customer 77') OR contains(lower(description), 'customer 77') OR contains(lower(array_to_string(iocs, '|')), 'customer 77')
ORDER BY o_orderdate DESC, id LIMIT 50""")
def alerts_text_search(spark, sf_dir):
    return _short(ops.by_text(_alerts(spark, sf_dir), "CUSTOMER 77"))


@query(_A + f"SELECT {_ID} FROM c WHERE list_contains(iocs, '10.1.1.44')")
def alerts_by_ip(spark, sf_dir):
    return _short(ops.by_ioc(_alerts(spark, sf_dir), "10.1.1.44"))


def _indexed(spark, sf_dir):
    """The alerts stored in two batches with an index each; the first one's every third alert is stored again, as another one, before."""
    alerts, path = _alerts(spark, sf_dir), scratch_path(spark, "indexed")
    third = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    alert_tables.write_batch(alerts.withColumns({"title": F.when(third, "Customer 77").otherwise(F.col("title")), "iocs": F.when(third, F.array(F.lit("10.1.1.44"))).otherwise(F.col("iocs"))}), path, 0)
    alert_tables.write_batch(alerts.filter(third), path, 1)
    for batch in (0, 1):
        alert_index.write_index(spark, path, batch)
    return path


@query(_A + f"""SELECT {_ID} FROM c
WHERE contains(lower(title), 'customer 77') OR contains(lower(description), 'customer 77') OR contains(lower(array_to_string(iocs, '|')), 'customer 77')
ORDER BY o_orderdate DESC, id LIMIT 50""")
def alerts_text_search_indexed(spark, sf_dir):
    """By trigram postings; what older rows of an alert held does not count."""
    return _short(alert_index.find_text(spark, _indexed(spark, sf_dir), "CUSTOMER 77"))


@query(_A + f"SELECT {_ID} FROM c WHERE list_contains(iocs, '10.1.1.44')")
def alerts_by_ip_indexed(spark, sf_dir):
    return _short(alert_index.find_ioc(spark, _indexed(spark, sf_dir), "10.1.1.44"))


@query(_A + f"SELECT {_ID} FROM a WHERE source_file = '/var/log/f3'")
def alerts_by_source(spark, sf_dir):
    return _short(ops.by_source(_alerts(spark, sf_dir), "/var/log/f3"))


@query(_A + f"SELECT {_ID} FROM a ORDER BY o_orderdate DESC, id LIMIT 20")
def alerts_recent(spark, sf_dir):
    return _short(ops.recent(_alerts(spark, sf_dir)))


@query(_A + """SELECT id, severity, title, description, 'Review the order' AS recommendation, array_to_string(iocs, '|') AS iocs,
  'syslog' AS log_format, source_file, o_orderkey % 100 AS chunk_index,
  CASE WHEN o_orderkey % 3 <> 0 THEN iso END AS timestamp_first,
  CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate + INTERVAL 90 SECOND, '%Y-%m-%dT%H:%M:%S') END AS timestamp_last,
  iso AS generated_at FROM c""")
def alert_export(spark, sf_dir):
    return ops.export_rows(_alerts(spark, sf_dir)).withColumn("iocs", F.array_join("iocs", "|"))


@query(_A + """SELECT id, CASE WHEN o_orderkey % 3 = 0 THEN 'INFO' ELSE severity END AS severity,
  CASE WHEN o_orderkey % 3 = 0 THEN 'newer' ELSE title END AS title FROM a""")
def alert_upsert_latest(spark, sf_dir):
    """Every third alert arrives again with new content and replaces the row as a whole."""
    current = _alerts(spark, sf_dir)
    again = current.filter(F.col("id").cast("bigint") % 3 == 0).withColumns(
        {"severity": F.lit("INFO"), "title": F.lit("newer")})
    return ops.upsert(current, again).select("id", "severity", "title")


@query(_A + """SELECT id, severity, title, left(description, 100) AS description,
  coalesce(array_to_string(list_transform(range(1, 1 + least(3, o_custkey % 6)), lambda i: left('order ' || o_orderkey || ' line ' || rpad(CAST(i AS VARCHAR), 130, 'x'), 120)), chr(10)), '') AS lines,
  CASE WHEN o_custkey % 6 > 3 THEN '... ' || (o_custkey % 6 - 3) || ' more' END AS more_lines,
  CASE WHEN len(iocs) = 0 THEN 'none' ELSE array_to_string(iocs[1:3], ', ') || CASE WHEN len(iocs) > 3 THEN '…' ELSE '' END END AS iocs,
  iso AS "at" FROM c""")
def alert_digest(spark, sf_dir):
    return ops.digest(_alerts(spark, sf_dir))


@query(_A + """SELECT id, 'block_ip' AS action, 'block ' || ip AS command,
  CASE WHEN o_orderkey % 8 = 0 THEN 'undo it' END AS undo FROM a WHERE o_orderkey % 4 IN (1, 2)""")
def remediation_plan(spark, sf_dir):
    return ops.remediation_plan(_alerts(spark, sf_dir))


_V = """WITH v AS (
  SELECT l_shipdate AS seen, l_suppkey, l_linenumber AS n, CASE l_linenumber % 5
    WHEN 0 THEN '11.' || (l_partkey // 65536 % 256) || '.' || (l_partkey // 256 % 256) || '.' || (l_partkey % 256) WHEN 1 THEN md5(CAST(l_partkey % 300 AS VARCHAR))
    WHEN 2 THEN 'p' || (l_partkey % 400) || '@example.org'
    WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN '/opt/' || (l_partkey % 90) ELSE 'C:\\tmp\\' || (l_partkey % 90) END
    ELSE 'word' || (l_partkey % 70) END AS value,
    CASE l_linenumber % 5 WHEN 0 THEN 'ip' WHEN 1 THEN 'hash' WHEN 2 THEN 'email' WHEN 3 THEN 'path' ELSE 'string' END AS type
  FROM lineitem),
m AS (
  SELECT value, any_value(type) AS type, strftime(min(seen), '%Y-%m-%d %H:%M:%S') AS first_seen,
         strftime(max(seen), '%Y-%m-%d %H:%M:%S') AS last_seen,
         CAST(sum(CASE WHEN n = 7 THEN 2 ELSE 1 END) AS BIGINT) AS alert_count FROM v GROUP BY value)
"""


def _mart(spark, sf_dir):
    return ops.ioc_mart(fx.line_alerts(spark, sf_dir))


def _texts(mart):
    return mart.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")})


@query(_V + "SELECT type, value, count(*) AS n FROM v GROUP BY type, value")
def ioc_classify(spark, sf_dir):
    value = F.element_at("iocs", 1)
    return fx.line_alerts(spark, sf_dir).select(value.alias("value")).withColumn("type", ioc_type(F.col("value"))).groupBy(
        "type", "value").agg(F.count(F.lit(1)).alias("n"))


@query(_V + "SELECT * FROM m")
def ioc_mart(spark, sf_dir):
    return _texts(_mart(spark, sf_dir))


@query(_V + "SELECT * FROM m")
def ioc_merge(spark, sf_dir):
    """Marts of two halves of the alerts, merged, equal the mart of all."""
    rows = fx.line_alerts(spark, sf_dir)
    half = F.col("suppkey") % 2 == 0
    return _texts(ops.ioc_merge(ops.ioc_mart(rows.filter(half)), ops.ioc_mart(rows.filter(~half))))


@query(_V + "SELECT * FROM m ORDER BY alert_count DESC, value LIMIT 10")
def top_iocs(spark, sf_dir):
    return _texts(ops.top_iocs(_mart(spark, sf_dir)))


@query(_V + "SELECT count(*) AS n FROM m")
def ioc_count(spark, sf_dir):
    return ops.ioc_count(_mart(spark, sf_dir))


@query(_A + """SELECT (SELECT count(*) FROM a) AS total_alerts,
  (SELECT string_agg(severity || '=' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM a GROUP BY severity)) AS by_severity,
  (SELECT count(DISTINCT i) FROM (SELECT unnest(iocs) AS i FROM c)) AS ioc_count,
  (SELECT count(DISTINCT (source_file, o_orderkey % 100)) FROM a) AS chunks_analyzed""")
def store_stats(spark, sf_dir):
    rows = _alerts(spark, sf_dir)
    stats = ops.store_stats(rows, ops.ioc_mart(rows), rows.select("source_file", "chunk_index").distinct())
    pairs = F.transform(F.array_sort(F.map_entries("by_severity")), lambda p: F.concat(
        p["key"], F.lit("="), p["value"].cast("string")))
    return stats.withColumn("by_severity", F.array_join(pairs, ","))


@query(_A + """SELECT id, severity, title, array_to_string(iocs, '|') AS iocs, iso AS generated_at FROM c""")
def alert_table_scan(spark, sf_dir):
    """Alerts written as a batch and read back, the batch written twice."""
    path = scratch_path(spark, "alerts")
    for _ in range(2):
        alert_tables.write_batch(_alerts(spark, sf_dir), path, 0)
    return ops.export_rows(alert_tables.read_alerts(spark, path)).select(
        "id", "severity", "title", F.array_join("iocs", "|").alias("iocs"), "generated_at")


@query(_A + """SELECT id, array_to_string(iocs, '|') AS iocs, o_custkey % 6 AS n_lines FROM c""")
def alert_row_decode(spark, sf_dir):
    """Arrays kept as JSON text; no text stands for an empty list."""
    rows = _alerts(spark, sf_dir).withColumns({
        "iocs": F.to_json("iocs"),
        "affected_lines": F.when(F.size("affected_lines") > 0, F.to_json("affected_lines"))})
    return alert_tables.decode_json_arrays(rows).select(
        "id", F.array_join("iocs", "|").alias("iocs"), F.size("affected_lines").cast("bigint").alias("n_lines"))


@query(_V + "SELECT value, alert_count FROM m")
def ioc_counters(spark, sf_dir):
    """Counters of two stored batches, added up; the second batch written twice."""
    path = scratch_path(spark, "iocs")
    rows = fx.line_alerts(spark, sf_dir).withColumns({
        "id": F.expr("uuid()"), "severity": F.lit("LOW"), "title": F.lit("t")})
    half = F.col("suppkey") % 2
    for batch_id, part in ((0, rows.filter(half == 0)), (1, rows.filter(half == 1)), (1, rows.filter(half == 1))):
        alert_tables.write_batch(part, path, batch_id)
        alert_tables.write_ioc_delta(spark, path, batch_id)
    return alert_tables.read_ioc_counters(spark, path).select("value", "alert_count")


@query("""SELECT o_orderkey, CAST(greatest(1, length(o_orderpriority) // 4) AS BIGINT) AS tokens,
  CASE o_orderstatus WHEN 'F' THEN 'ip' WHEN 'O' THEN 'path' ELSE 'string' END AS type,
  CAST(CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 99 END AS INTEGER) AS rank FROM orders""")
def sql_functions(spark, sf_dir):
    """The functions registered for SQL."""
    register_sql_functions(spark)
    fx.table(spark, sf_dir, "orders").createOrReplaceTempView("emberlog_orders")
    return spark.sql("""
        SELECT o_orderkey, token_estimate(o_orderpriority) AS tokens,
               ioc_type(CASE o_orderstatus WHEN 'F' THEN '1.2.3.4' WHEN 'O' THEN '/tmp' ELSE o_orderstatus END) AS type,
               severity_rank(CASE left(o_orderpriority, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' ELSE 'x' END) AS rank
        FROM emberlog_orders""")


def _halves(spark, sf_dir, write):
    """All alerts in a new store, odd customers' in the second of two batches."""
    alerts, path = _alerts(spark, sf_dir), scratch_path(spark, "halves")
    odd = F.pmod(F.regexp_extract("title", r"(\d+)$", 1).cast("long"), F.lit(2)) == 1
    for batch, part in ((0, ~odd), (1, odd)):
        alert_tables.write_batch(alerts.filter(part), path, batch)
        write(path, batch)
    return path


@query(_A + """, v AS (SELECT unnest(iocs) AS value FROM c), n AS (SELECT value, count(*) AS n FROM v GROUP BY value)
SELECT count(*) AS exact, true AS distinct_close, true AS top_close, CAST(sum(n) AS BIGINT) AS occurrences FROM n""")
def ioc_sketches(spark, sf_dir):
    """Distinct and frequent indicators merged from the summaries of two batches, within their bounds of the exact counts."""
    path = _halves(spark, sf_dir, lambda path, batch: alert_sketches.write_sketches(spark, path, batch))
    merged = alert_sketches.read_sketches(spark, path, 10)
    exact = ops.ioc_mart(_alerts(spark, sf_dir)).select("value", F.col("alert_count").alias("_n"))
    slack = 2 * F.col("occurrences") / alert_sketches.TRACKED
    top = merged.select("occurrences", F.explode("top").alias("t")).join(exact, F.col("t.value") == F.col("value"), "left")
    close = top.agg(F.min(F.abs(F.col("t.n") - F.coalesce("_n", F.lit(0))) <= slack).alias("top_close"))
    count = exact.agg(F.count(F.lit(1)).alias("exact"))
    return merged.select("occurrences", "distinct_iocs").withColumns({"exact": count.scalar(), "top_close": close.scalar()}).select(
        "exact", (F.abs(F.col("distinct_iocs") - F.col("exact")) <= alert_sketches.DISTINCT_ERROR * F.col("exact")).alias("distinct_close"), "top_close", "occurrences")


@query(_A + f"SELECT {_ID} FROM a WHERE o_custkey % 2 = 1")
def store_cleared(spark, sf_dir):
    """A store made empty, filled, cleared, and filled again with the alerts of odd customers."""
    path = scratch_path(spark, "cleared")
    alert_tables.create(spark, path)
    alert_tables.write_batch(_alerts(spark, sf_dir), path, 0)
    alert_tables.write_ioc_delta(spark, path, 0)
    alert_tables.clear(spark, path)
    odd = F.pmod(F.regexp_extract("title", r"(\d+)$", 1).cast("long"), F.lit(2)) == 1
    alert_tables.write_batch(_alerts(spark, sf_dir).filter(odd), path, 1)
    return _short(alert_tables.read_alerts(spark, path))
