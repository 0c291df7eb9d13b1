"""Syslog: RFC 5424, BSD and journald lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.scalars import first_ip, let
from emberlog.schema import UNKNOWN, Record, either, entry

# --- fixed values -----------------------------------------------------------------
LEVELS = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]
FACILITIES = [
    "kern", "user", "mail", "daemon", "auth", "syslog",
    "lpr", "news", "uucp", "cron", "authpriv", "ftp",
]
PRI = r"^<(\d+)>"
RFC5424 = (
    r"^<(\d+)>1\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"
    r"\s+(\S+)\s+(\S+)\s+\S+\s+\S+\s+\S+\s*([^\n]*)"
)
BSD = (
    r"^(?:<(\d+)>)?(\w{3}\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2})"
    r"\s+(\S+)\s+([\w\-\.\/]+)(?:\[(\d+)\])?:\s*([^\n]*)"
)
JOURNALD = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
    r"\s+(\S+)\s+([\w\-\.\/]+)(?:\[(\d+)\])?:\s*([^\n]*)"
)
BASE_YEAR = 2000  # a leap year, so that 29 February parses
# ----------------------------------------------------------------------------------

_RFC, _BSD, _JRN = "rfc5424", "bsd", "journald"


def score(raw: Column) -> Column:
    """1 for a line of any of the three grammars, else 0."""
    return (raw.rlike(BSD) | raw.rlike(RFC5424) | raw.rlike(JOURNALD)).cast("int")


def tokens(raw: Column) -> Column:
    """[grammar, pri, time, host, process, pid, message], or one element when no grammar fits.

    A match is rewritten to its groups joined by line feeds, which a log line cannot contain; a rewritten line no
    longer matches the grammar after it. The first character tells which grammars can fit at all: RFC 5424 needs
    ``<``, journald a digit, and most lines are put to one grammar only.
    """
    rest = r"[\s\S]*$"

    def rfc5424(text: Column) -> Column:
        return F.regexp_replace(text, RFC5424 + rest, f"{_RFC}\n$1\n$2\n$3\n$4\n\n$5")

    def bsd(text: Column) -> Column:
        return F.regexp_replace(text, BSD + rest, f"{_BSD}\n$1\n$2\n$3\n$4\n$5\n$6")

    def journald(text: Column) -> Column:
        return F.regexp_replace(text, JOURNALD + rest, f"{_JRN}\n\n$1\n$2\n$3\n$4\n$5")

    first = F.substr(raw, F.lit(1), F.lit(1))
    out = F.when(first == "<", bsd(rfc5424(raw))).when(first.between("0", "9"), journald(bsd(raw))).otherwise(bsd(raw))
    return F.split(out, "\n")


def facility(pri: Column) -> Column:
    """Name of the facility in a priority number, the number itself above 11; null for an empty text."""
    code = F.when(pri != "", F.shiftright(pri.try_cast("bigint"), 3))  # a failing cast is slow, so none is tried on ""
    return let(code, lambda c: F.when(c < len(FACILITIES), F.get(F.lit(FACILITIES), c.cast("int"))).otherwise(
        c.cast("string")))


def level(pri: Column) -> Column:
    # 1000 is a multiple of 8, so the last three digits decide the level however long the number is
    return F.when(pri != "", F.get(F.lit(LEVELS), F.right(pri, F.lit(3)).cast("int").bitwiseAND(7)))


def pri_of(raw: Column) -> Column:
    """Priority number at the start of any line, as text."""
    return F.regexp_extract(raw, PRI, 1)


def bsd_timestamp(text: Column, base_year: int = BASE_YEAR) -> Column:
    one_blank = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(F.concat(F.lit(f"{base_year} "), one_blank), F.lit("yyyy MMM d HH:mm:ss"))


def timestamp(tok: Column, base_year: int = BASE_YEAR) -> Column:
    text = F.get(tok, F.lit(2))
    iso = F.regexp_replace(text, r"\s+", " ").try_cast("timestamp")
    return F.when(F.get(tok, F.lit(0)) == _BSD, bsd_timestamp(text, base_year)).otherwise(iso)


def parse(raw: Column, tok: Column, base_year: int = BASE_YEAR) -> Record:
    """Record of one line; ``tok`` is the column holding ``tokens(raw)``."""
    kind, pri, host, process, pid, message = (F.get(tok, F.lit(i)) for i in (0, 1, 3, 4, 5, 6))
    pid = F.when(pid != "", pid)
    matched = F.size(tok) == 7
    is_rfc = kind == _RFC
    # one search for an address: in the message, in the whole line when no grammar fits, not in RFC 5424 lines
    searched = F.when(~matched, raw).when(~is_rfc, message)
    more = F.when(is_rfc, F.create_map(F.lit("process"), process)).otherwise(
        F.create_map(F.lit("process"), process, F.lit("pid"), pid)
    )
    known = entry(
        format=F.lit("syslog"),
        message=message,
        event_ts=timestamp(tok, base_year),
        host=host,
        facility=facility(pri),
        level=level(pri),
        process=process,
        pid=pid,
        extra=more,
    )
    record = either(matched, known, entry(format=F.lit(UNKNOWN), message=raw))
    return {**record, "source_ip": first_ip(searched)}
