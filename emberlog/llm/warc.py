"""WARC: records as rows, and not-modified revisits resolved to the latest earlier full response of their URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stored
from emberlog.operators.ordered import last_before

#: Fields of a 304 that must not replace those of the response it confirms (RFC 9111, 3.2): framing, hop by hop, and what
#: describes the stored body.
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
        "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
NOT_MODIFIED = "server-not-modified"
#: Rows of one URL are put in order by blocks of so many milliseconds.
BLOCK_MS = 86_400_000
FIELDS = "array<struct<name:string,value:string>>"


def read_warc(spark: SparkSession, path: str, version: str = "WARC/1.0") -> DataFrame:
    """The records of WARC files, plain or gzipped, one text each (column value) without its version line.

    Files are read as a stream cut at version lines, so no file is held whole; a payload that holds a version line as a line of
    its own is cut there too.
    """
    return spark.read.option("lineSep", version + "\r\n").text(path).filter(F.length("value") > 0)


def fields(head: Column) -> Column:
    """Header lines as (name in lower case, value); lines without a colon go."""
    lines = F.filter(F.split(head, "\r?\n"), lambda line: F.instr(line, ":") > 1)
    return F.transform(lines, lambda line: F.struct(
        F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
        F.trim(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value")))


def value_of(headers: Column, name: str) -> Column:
    """The last value of a header field; null if it is not there."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(-1))["value"]


def parse_records(records: DataFrame, value: str = "value") -> DataFrame:
    """WARC records (texts without version line) as columns: record_id, warc_type, target_uri, at (ms), profile, status, headers, payload.

    ``headers`` are the HTTP fields and ``payload`` the body of records that hold an HTTP response, else null. A record that is
    cut off or no record gives nulls in what it lacks; none is dropped.
    """
    def head(c: Column) -> Column:
        return F.substring_index(c, "\r\n\r\n", 1)

    def rest(c: Column) -> Column:
        return F.substring(c, F.length(head(c)) + 5, F.length(c))

    cut = records.select(F.coalesce(F.col(value), F.lit("")).alias("_v")).select(fields(head(F.col("_v"))).alias("_warc"), rest(F.col("_v")).alias("_block"))
    cut = cut.withColumn("_http", head(F.col("_block"))).withColumn("_is", F.col("_http").startswith("HTTP/"))
    named = lambda name: value_of(F.col("_warc"), name)
    return cut.select(
        named("warc-record-id").alias("record_id"), F.lower(named("warc-type")).alias("warc_type"), named("warc-target-uri").alias("target_uri"),
        F.unix_millis(F.try_to_timestamp(named("warc-date"))).alias("at"), named("warc-profile").alias("profile"),
        F.when(F.col("_is"), F.try_element_at(F.split(F.substring_index("_http", "\r\n", 1), " "), F.lit(2)).try_cast("int")).alias("status"),
        F.when(F.col("_is"), fields(F.col("_http"))).alias("headers"),
        F.when(F.col("_is") & (named("warc-type") == "response"), F.regexp_replace(rest(F.col("_block")), "\r\n\r\n$", "")).alias("payload"))


def canonical_url(url: Column) -> Column:
    """URLs that differ in scheme, case of the host, www, default port, user, fragment, closing slashes, order of parameters or
    utm parameters only are one; null if there is no host."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    wanted = F.filter(F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    query = F.array_join(F.array_sort(wanted), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def merged(stored: Column, update: Column) -> Column:
    """The stored response's fields, then what the 304 updates: its permitted fields replace all stored ones of their name."""
    listed = F.split(F.lower(F.coalesce(value_of(update, "connection"), F.lit(""))), "[ ,]+")
    permitted = F.filter(update, lambda h: ~h["name"].isin(*KEPT) & ~F.array_contains(listed, h["name"]))
    return F.concat(F.filter(stored, lambda h: ~F.exists(permitted, lambda p: p["name"] == h["name"])), permitted)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit: record_id, url, at, outcome, response_id, response_at, headers.

    ``records`` as of ``parse_records`` (payload not needed). A revisit with the server-not-modified profile or status 304 is
    joined with the latest response of status 200 of its canonical URL before it (at the same time does not count; of several
    at one time, the greatest record id). Its ETag must be that response's (weak comparison), or without one its Last-Modified.
    outcome: resolved, or why not: no_response, mismatch, no_validator. ``headers`` are the response's with the permitted fields
    of the 304 merged in, null unless resolved. Revisits without URL or time find no response. Repeated records are kept.

    Rows of one URL are ordered in blocks of a day, so a URL that holds a third of all records is many tasks' work; no payload
    is moved.
    """
    tag = lambda h: F.regexp_replace(value_of(h, "etag"), "^W/", "")
    # what is read several times is stored without the payloads
    rows = stored(records.select("record_id", "warc_type", canonical_url(F.col("target_uri")).alias("url"), "at", "profile", "status", "headers"), "records")
    asked = (F.col("warc_type") == "revisit") & (F.coalesce(F.col("profile").contains(NOT_MODIFIED), F.lit(False)) | (F.col("status") == 304))
    placed = F.col("url").isNotNull() & F.col("at").isNotNull()
    full = rows.filter((F.col("warc_type") == "response") & (F.col("status") == 200) & placed).groupBy("url", "at").agg(
        F.max(F.struct("record_id", F.coalesce("headers", F.array().cast(FIELDS)).alias("headers"), "at")).alias("response"))
    revisits = rows.filter(asked).select("record_id", "url", "at", F.coalesce("headers", F.array().cast(FIELDS)).alias("update"))
    # at one time a revisit comes before a response, so that the response is not before it
    both = revisits.filter(placed).withColumn("_order", F.col("at") * 2).withColumn("response", F.lit(None).cast(full.schema["response"].dataType)).unionByName(
        full.withColumn("_order", F.col("at") * 2 + 1), allowMissingColumns=True)
    found = last_before(both, ["url"], "_order", "response", "found", 2 * BLOCK_MS).filter("response is null").drop("response", "_order")
    lost = revisits.filter(~placed).withColumn("found", F.lit(None).cast(full.schema["response"].dataType))
    every = found.unionByName(lost)
    theirs, ours = F.col("found.headers"), F.col("update")
    checked = F.coalesce(tag(ours) == tag(theirs), F.when(tag(ours).isNull(), value_of(ours, "last-modified") == value_of(theirs, "last-modified")), F.lit(False))
    outcome = (F.when(F.col("found").isNull(), "no_response").when(tag(ours).isNull() & value_of(ours, "last-modified").isNull(), "no_validator")
               .when(checked, "resolved").otherwise("mismatch"))
    return every.withColumn("outcome", outcome).select(
        "record_id", "url", "at", "outcome", F.col("found.record_id").alias("response_id"), F.col("found.at").alias("response_at"),
        F.when(F.col("outcome") == "resolved", merged(theirs, ours)).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits as full responses: joined with the payload of the response that they were resolved to."""
    bodies = records.filter("warc_type = 'response'").groupBy(F.col("record_id").alias("response_id")).agg(F.first("payload").alias("payload"))
    return resolved.filter("outcome = 'resolved'").join(bodies, "response_id")


def render_captures(pages: DataFrame) -> DataFrame:
    """Two WARC records for each page (page_id, url, html), as texts: its response, and a later not-modified revisit.

    Captures are a minute apart by page id, revisits a week later. By page id the revisit has the page's ETag, a weak one, only
    a Last-Modified, or no validator; its other fields update some of the response's and try to change its framing.
    """
    page = F.coalesce(F.col("page_id"), F.lit(0))
    moment = lambda seconds: F.date_format(F.timestamp_seconds(F.lit(1704067200) + page * 60 + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body, n = F.coalesce(F.col("html"), F.lit("")), F.col("page_id").cast("string")
    tag = F.concat(F.lit('"'), F.substring(F.md5(body), 1, 16), F.lit('"'))
    lines = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.pmod(page, F.lit(4))
    validators = (F.when(kind == 0, lines("ETag: ", tag, "\r\n")).when(kind == 1, lines("ETag: W/", tag, "\r\n"))
                  .when(kind == 2, lines("Last-Modified: ", moment(0), "\r\n")).otherwise(""))
    response = lines(
        "WARC-Type: response\r\nWARC-Record-ID: <urn:page:", n, ">\r\nWARC-Target-URI: ", F.coalesce("url", F.lit("")), "\r\nWARC-Date: ", moment(0),
        "\r\nContent-Type: application/http; msgtype=response\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: ", tag, "\r\nLast-Modified: ", moment(0),
        "\r\nCache-Control: max-age=60\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n", body, "\r\n\r\n")
    revisit = lines(
        "WARC-Type: revisit\r\nWARC-Record-ID: <urn:again:", n, ">\r\nWARC-Target-URI: ", F.coalesce("url", F.lit("")), "\r\nWARC-Date: ", moment(7 * 86400),
        "\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified\r\n\r\nHTTP/1.1 304 Not Modified\r\n", validators,
        "Cache-Control: max-age=3600\r\nContent-Length: 0\r\nX-Cache: hit\r\nConnection: x-cache\r\n\r\n")
    return pages.filter("page_id is not null").select(F.explode(F.array(response, revisit)).alias("value"))
