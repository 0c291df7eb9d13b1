"""Web access lines in the common and combined log formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.scalars import let
from emberlog.schema import UNKNOWN, Record, either, entry

# --- fixed values -----------------------------------------------------------------
LINE = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)'
    r'(?:\s+"([^"]*)"\s+"([^"]*)")?'
)
REQUEST = r"^(\S+)\s+(\S+)\s+(\S+)$"
# ----------------------------------------------------------------------------------


def score(raw: Column) -> Column:
    return raw.rlike(LINE).cast("int")


def tokens(raw: Column) -> Column:
    """[ip, user, time, request, status, bytes, referer, agent] and then [method, path] of a request of three words, or
    [request] of any other; one element when the line does not fit.
    """
    fields = F.split(F.regexp_replace(raw, LINE + r"[\s\S]*$", "$1\n$2\n$3\n$4\n$5\n$6\n$7\n$8"), "\n")

    def with_request(t: Column) -> Column:
        words = F.split(F.regexp_replace(F.get(t, F.lit(3)), REQUEST, "$1\n$2"), "\n")
        return F.when(F.size(t) == 8, F.concat(t, words)).otherwise(t)

    return let(fields, with_request)


def _dash(text: Column) -> Column:
    return F.when((text != "-") & (text != ""), text)


def method(tok: Column) -> Column:
    return F.when(F.size(tok) == 10, F.get(tok, F.lit(8)))


def path(tok: Column) -> Column:
    """Second of three words, else the whole request."""
    return F.try_element_at(tok, F.lit(-1))


def level(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO")


def message(tok: Column) -> Column:
    return F.concat(F.coalesce(method(tok), F.lit("?")), F.lit(" "), path(tok), F.lit(" → "), F.get(tok, F.lit(4)))


def timestamp(text: Column) -> Column:
    def read(t: Column) -> Column:
        colon_zone = t.rlike(r"(Z|:\d\d:\d\d [+-]\d\d:\d\d)$")
        return F.when(colon_zone, F.try_to_timestamp(t, F.lit("d/MMM/yyyy:H:m:s XXX"))).otherwise(
            F.try_to_timestamp(t, F.lit("d/MMM/yyyy:H:m:s Z")))

    return let(F.regexp_replace(text, r"\s+", " "), read)


def parse(raw: Column, tok: Column) -> Record:
    """Record of one line; ``tok`` is the column holding ``tokens(raw)``."""
    ip, user, ts, _, status, size, referer, agent = (F.get(tok, F.lit(i)) for i in range(8))
    status = F.when(F.size(tok) > 8, status.cast("int"))
    promoted = {
        "method": method(tok),
        "path": path(tok),
        "status_code": status,
        "bytes_sent": size,
        "referer": _dash(referer),
        "user_agent": _dash(agent),
        "auth_user": _dash(user),
    }
    always = {"method", "path", "status_code", "bytes_sent"}
    pairs = F.create_map(*[x for k, v in promoted.items() for x in (F.lit(k), v.cast("string"))])
    known = entry(
        format=F.lit("clf"),
        message=message(tok),
        event_ts=timestamp(ts),
        source_ip=F.when(ip != "-", ip),
        level=level(status),
        extra=F.map_filter(pairs, lambda k, v: k.isin(*always) | v.isNotNull()),
        **promoted,
    )
    return either(F.size(tok) > 8, known, entry(format=F.lit(UNKNOWN), message=raw))


def bytes_number(size: Column) -> Column:
    """Bytes sent as a number; ``-`` (nothing sent) is null."""
    return F.when(size != "-", size.try_cast("bigint"))
