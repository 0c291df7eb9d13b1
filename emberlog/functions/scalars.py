"""Scalar column expressions shared by every job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import SEVERITIES, UNRANKED

# --- fixed values: patterns -------------------------------------------------------
IPV4 = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
IOC_IP = r"^\d{1,3}(?:\.\d{1,3}){3}$"
IOC_HASH = r"^[a-fA-F0-9]{32,64}$"
IOC_DRIVE = r"^[A-Za-z]:\\"
# ----------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop white space at both ends (tabs and form feeds too, unlike ``trim``)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_ip(text: Column) -> Column:
    """First dotted quad, without an octet range check; null when there is none."""
    return let(F.regexp_extract(text, IPV4, 1), lambda ip: F.when(ip != "", ip))


def all_ips(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(1))


def token_estimate(text: Column) -> Column:
    """About one token per four characters, and at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4))


def severity_rank(severity: Column) -> Column:
    """0 for CRITICAL up to 4 for INFO; names outside the list rank 99."""
    rank = F.array_position(F.lit(SEVERITIES), severity)
    return F.when(rank > 0, rank - 1).otherwise(F.lit(UNRANKED)).cast("int")


def rank_of(severity: str) -> int:
    """``severity_rank`` of a name known when the query is written."""
    return SEVERITIES.index(severity) if severity in SEVERITIES else UNRANKED


def ioc_type(value: Column) -> Column:
    """ip, hash, email, path or string, tested in that order."""
    return (
        F.when(value.rlike(IOC_IP), "ip")
        .when(value.rlike(IOC_HASH), "hash")
        .when(value.contains("@") & value.contains("."), "email")
        .when(value.startswith("/") | value.rlike(IOC_DRIVE), "path")
        .otherwise("string")
    )


def epoch_second(ts: Column) -> Column:
    return F.unix_seconds(F.date_trunc("second", ts))


def is_private_ip(ip: Column) -> Column:
    """RFC 1918 address."""
    return ip.startswith("10.") | ip.startswith("192.168.") | (
        ip.startswith("172.") & ip.rlike(r"^172\.(1[6-9]|2\d|3[01])\."))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Literal dictionary lookup; null when the key is missing."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions for ``spark.sql`` users; they inline into the plan like any expression."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS BIGINT "
        "RETURN greatest(1L, char_length(coalesce(t, '')) div 4)"
    )
    ranks = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION severity_rank(s STRING) RETURNS INT "
        f"RETURN CASE s {ranks} ELSE {UNRANKED} END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION ioc_type(v STRING) RETURNS STRING RETURN CASE "
        f"WHEN v RLIKE r'{IOC_IP}' THEN 'ip' WHEN v RLIKE r'{IOC_HASH}' THEN 'hash' "
        "WHEN contains(v, '@') AND contains(v, '.') THEN 'email' "
        f"WHEN startswith(v, '/') OR v RLIKE r'{IOC_DRIVE}' THEN 'path' ELSE 'string' END"
    )
