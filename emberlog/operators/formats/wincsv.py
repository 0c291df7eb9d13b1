"""Windows event logs exported as CSV with a header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.csvline import split_csv
from emberlog.functions.scalars import first_ip, let, lookup, strip
from emberlog.schema import UNKNOWN, Record, either, entry

# --- fixed values -----------------------------------------------------------------
KNOWN_HEADERS = [
    "TimeCreated", "Date and Time", "EventId", "Event ID", "Id",
    "LevelDisplayName", "Level", "Source", "Task", "Message",
    "Task Category", "Computer", "UserName",
]
TIME_COLUMNS = ["TimeCreated", "Date and Time", "Date", "Time"]
LEVEL_COLUMNS = ["LevelDisplayName", "Level"]
SOURCE_COLUMNS = ["Source", "ProviderName", "EventSource"]
ID_COLUMNS = ["EventId", "Event ID", "Id"]
TASK_COLUMNS = ["Task", "Task Category", "TaskDisplayName"]
MESSAGE_COLUMNS = ["Message", "Description"]
USER_COLUMNS = ["UserName", "AccountName", "SubjectUserName"]
HOST_COLUMNS = ["Computer", "MachineName", "ComputerName"]
LEVEL_NAMES = {
    "critical": "CRITICAL", "error": "ERROR", "warning": "WARNING",
    "information": "INFO", "verbose": "DEBUG",
    "audit failure": "WARNING", "audit success": "INFO",
}
HEADER_MESSAGE = "[CSV header]"
# ----------------------------------------------------------------------------------

NAMED = (
    TIME_COLUMNS + LEVEL_COLUMNS + SOURCE_COLUMNS + ID_COLUMNS
    + TASK_COLUMNS + MESSAGE_COLUMNS + USER_COLUMNS + HOST_COLUMNS
)


def trimmed_fields(raw: Column) -> Column:
    return F.transform(split_csv(raw), strip)


def header_score(first_line: Column) -> Column:
    """Known header names on the first line, three or more counting as certain."""
    known = F.array_intersect(trimmed_fields(first_line), F.lit(KNOWN_HEADERS))
    return F.least(F.lit(1.0), F.size(known) / F.lit(3.0))


def first_present(row: Column, names: list[str]) -> Column:
    """First of the named columns that is there and not empty."""
    return F.get(F.filter(F.transform(F.lit(names), lambda n: F.try_element_at(row, n)), lambda v: v != ""), F.lit(0))


def timestamp(text: Column) -> Column:
    """US 12-hour, ISO with T, ISO with a blank, or day-first 24-hour time; told apart by their shapes."""

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(r"(?i)[ap]m$"), F.try_to_timestamp(t, F.lit("M/d/yyyy h:m:s a")))
            .when(t.rlike(r"^\d{4}-[^T]*T"), F.try_to_timestamp(t, F.lit("yyyy-M-d'T'H:m:s")))
            .when(t.rlike(r"^\d{4}-"), F.try_to_timestamp(t, F.lit("yyyy-M-d H:m:s")))
            .otherwise(F.try_to_timestamp(t, F.lit("d/M/yyyy H:m:s")))
        )

    return let(F.regexp_replace(text, r"\s+", " "), read)


def level(text: Column) -> Column:
    return let(text, lambda t: F.coalesce(lookup(LEVEL_NAMES, F.lower(t)), F.upper(t)))


def row_map(header: Column, values: Column) -> Column:
    """Column name to value; a repeated name keeps its last value."""
    n = F.size(header)
    pairs = F.filter(
        F.arrays_zip(header.alias("k"), values.alias("v")),
        lambda p, i: F.array_position(F.reverse(header), p["k"]) == n - i,
    )
    plain = F.map_from_arrays(header, values)
    return F.when(F.size(F.array_distinct(header)) == n, plain).otherwise(F.map_from_entries(pairs))


def extra(row: Column) -> Column:
    """Event id, task and account under fixed names, plus every filled column without a known meaning."""
    other = F.map_filter(row, lambda k, v: ~k.isin(*NAMED) & (v != ""))
    named = F.create_map(
        F.lit("event_id"), first_present(row, ID_COLUMNS),
        F.lit("task_category"), first_present(row, TASK_COLUMNS),
        F.lit("account_name"), first_present(row, USER_COLUMNS),
    )
    return F.map_concat(
        F.map_filter(named, lambda k, v: v.isNotNull() & ~F.map_contains_key(other, k)), other
    )


def tokens(raw: Column, header: Column) -> Column:
    """Column map of a data line; null when the field count differs from the header's."""

    def fitting(values: Column) -> Column:
        return F.when(F.size(values) == F.size(header), row_map(header, values))

    return let(trimmed_fields(raw), fitting)


def parse(raw: Column, row: Column, is_header: Column) -> Record:
    """Record of one line; ``row`` is the column holding ``tokens(raw, header)``."""
    message = F.coalesce(first_present(row, MESSAGE_COLUMNS), raw)
    known = entry(
        format=F.lit("windows_csv"),
        message=message,
        event_ts=timestamp(first_present(row, TIME_COLUMNS)),
        source_ip=first_ip(message),
        host=first_present(row, HOST_COLUMNS),
        facility=first_present(row, SOURCE_COLUMNS),
        level=level(first_present(row, LEVEL_COLUMNS)),
        event_id=first_present(row, ID_COLUMNS),
        task_category=first_present(row, TASK_COLUMNS),
        account_name=first_present(row, USER_COLUMNS),
        extra=extra(row),
    )
    header = entry(format=F.lit("windows_csv"), message=F.lit(HEADER_MESSAGE))
    return either(is_header, header, either(row.isNotNull(), known, entry(format=F.lit(UNKNOWN), message=raw)))


def headers(lines: DataFrame, dense: bool = False) -> DataFrame:
    """First line of every file: ``source_file, header_at, header``.

    With ``dense`` line numbers, as given by ``number_lines``, a filter finds it; else one small row per file leaves each
    task.
    """
    at = F.struct("block_start", "row_id") if "row_id" in lines.columns else F.struct("line_no")
    if dense:
        first = lines.filter("line_no = 1").select("source_file", at.alias("header_at"), F.col("raw").alias("_first"))
    else:
        first = lines.groupBy("source_file").agg(F.min(at).alias("header_at"), F.min_by("raw", at).alias("_first"))
    return first.select("source_file", "header_at", trimmed_fields(F.col("_first")).alias("header"))
