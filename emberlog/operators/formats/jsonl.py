"""JSON-lines logs with differing key names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.scalars import first_ip, let, lookup
from emberlog.schema import UNKNOWN, Record, either, entry

# --- fixed values -----------------------------------------------------------------
TIME_KEYS = ["timestamp", "time", "@timestamp", "ts", "date", "datetime", "created_at"]
MESSAGE_KEYS = ["message", "msg", "log", "text", "body", "event", "description"]
LEVEL_KEYS = ["level", "severity", "loglevel", "log_level", "lvl", "priority", "status"]
IP_KEYS = ["src_ip", "source_ip", "remote_addr", "client_ip", "ip", "remote_ip", "sourceIPAddress"]
HOST_KEYS = ["host", "hostname", "server", "node", "machine", "source"]
LEVEL_NAMES = {
    "fatal": "CRITICAL", "panic": "CRITICAL",
    "error": "ERROR", "err": "ERROR",
    "warn": "WARNING", "warning": "WARNING",
    "info": "INFO", "information": "INFO",
    "debug": "DEBUG", "trace": "DEBUG",
}
# ----------------------------------------------------------------------------------

ALIASES = TIME_KEYS + MESSAGE_KEYS + LEVEL_KEYS + IP_KEYS + HOST_KEYS


def _last_of_each_key(m: Column) -> Column:
    keys = F.map_keys(m)
    entries = F.filter(
        F.map_entries(m),
        lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(m) - i,
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(m), m).otherwise(F.map_from_entries(entries))


def fields(raw: Column) -> Column:
    """Top-level fields as text when the line is exactly one JSON object, else null.

    Reading the line as the only element of an array rejects trailing text, arrays and scalars. A line that closes
    that array itself is caught by the second reading, done only for lines holding a brace and then a bracket.
    """
    as_list = F.from_json(
        F.concat(F.lit("["), raw, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"}
    )
    with_tail = F.size(F.from_json(F.concat(F.lit("["), raw, F.lit(",0]")), "array<string>"))
    whole = F.when(raw.rlike(r"\}\s*\]"), with_tail == 2).otherwise(True)
    only = let(as_list, lambda w: F.when((F.size(w) == 1) & whole, F.get(w, F.lit(0))))
    return let(only, _last_of_each_key)


def score(raw: Column) -> Column:
    return fields(raw).isNotNull().cast("int")


def alias_value(m: Column, keys: list[str]) -> Column:
    """Value of the first key present, even when that value is null."""
    present = F.filter(F.lit(keys), lambda k: F.map_contains_key(m, k))
    return F.try_element_at(m, F.get(present, F.lit(0)))


def timestamp(text: Column, apply_offset: bool = False) -> Column:
    """ISO times; fractions, ``Z`` and offsets are dropped unless ``apply_offset`` is set."""
    if apply_offset:
        return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]"), text.try_cast("timestamp"))

    def shaped(t: Column) -> Column:
        blank = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$")
        bare = F.regexp_replace(F.regexp_replace(t, r"\.\d+", ""), r"[+-]\d{2}:\d{2}$", "")
        return F.when(blank, F.regexp_replace(t, r"\s+", "T")).otherwise(F.replace(bare, F.lit("Z"), F.lit("")))

    return F.try_to_timestamp(let(text, shaped), F.lit("yyyy-M-d'T'H:m:s"))


def level(text: Column) -> Column:
    return let(text, lambda t: F.coalesce(lookup(LEVEL_NAMES, F.lower(t)), F.upper(t)))


def message(m: Column, raw: Column) -> Column:
    return let(alias_value(m, MESSAGE_KEYS), lambda t: F.when(t != "", t).otherwise(raw))


def source_ip(m: Column, raw: Column) -> Column:
    return let(alias_value(m, IP_KEYS), lambda ip: F.when(ip != "", ip).otherwise(first_ip(message(m, raw))))


def extra(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*ALIASES))


def parse(raw: Column, m: Column, apply_offset: bool = False) -> Record:
    """Record of one line; ``m`` is the column holding ``fields(raw)``."""
    known = entry(
        format=F.lit("json"),
        message=message(m, raw),
        event_ts=timestamp(alias_value(m, TIME_KEYS), apply_offset),
        source_ip=source_ip(m, raw),
        host=alias_value(m, HOST_KEYS),
        level=level(alias_value(m, LEVEL_KEYS)),
        extra=extra(m),
    )
    return either(m.isNotNull(), known, entry(format=F.lit(UNKNOWN), message=raw))
