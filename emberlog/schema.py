"""Schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------
LOG_FORMATS = ["syslog", "clf", "json", "windows_csv"]
UNKNOWN = "unknown"
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
UNRANKED = 99
CHUNK_TOKENS = 1500
MAX_AFFECTED_LINES = 10
MAX_TITLE_CHARS = 80
MAX_CONTEXT_CHARS = 1500
INTEL_TOP_N = 3
# ----------------------------------------------------------------------------------

_EXTRA = T.MapType(T.StringType(), T.StringType())

# Columns a format adds beyond the common core; null where a format has no such field.
PROMOTED = [
    ("process", T.StringType()),
    ("pid", T.StringType()),
    ("method", T.StringType()),
    ("path", T.StringType()),
    ("status_code", T.IntegerType()),
    ("bytes_sent", T.StringType()),
    ("referer", T.StringType()),
    ("user_agent", T.StringType()),
    ("auth_user", T.StringType()),
    ("event_id", T.StringType()),
    ("task_category", T.StringType()),
    ("account_name", T.StringType()),
]

ENTRY = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("facility", T.StringType()),
        T.StructField("level", T.StringType()),
        *[T.StructField(n, t) for n, t in PROMOTED],
        T.StructField("extra", _EXTRA),
    ]
)

REMEDIATION = T.StructType(
    [
        T.StructField("action", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("reversible", T.BooleanType()),
        T.StructField("undo_command", T.StringType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("iocs", T.ArrayType(T.StringType())),
        T.StructField("affected_lines", T.ArrayType(T.StringType())),
        T.StructField("log_format", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("timestamp_first", T.TimestampType()),
        T.StructField("timestamp_last", T.TimestampType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("remediation", REMEDIATION),
    ]
)

IOC = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("alert_count", T.LongType()),
    ]
)

INTEL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("cvss", T.DoubleType()),
        T.StructField("metadata", _EXTRA),
    ]
)

# Keys of an exported alert, in order.
EXPORT_KEYS = [
    "id", "severity", "title", "description", "recommendation", "iocs", "log_format",
    "source_file", "chunk_index", "timestamp_first", "timestamp_last", "generated_at",
]


Record = dict[str, Column]


def entry(**fields: Column) -> Record:
    """All record columns by name; those not given are null (``extra``: an empty map).

    Fields stay separate expressions, so that a query pays only for the ones it uses.
    """
    empty = F.create_map().cast(_EXTRA)
    return {
        f.name: fields.get(f.name, empty if f.name == "extra" else F.lit(None)).cast(f.dataType) for f in ENTRY.fields
    }


def either(condition: Column, yes: Record, no: Record) -> Record:
    return {name: F.when(condition, yes[name]).otherwise(no[name]) for name in yes}


def conform(df, schema: T.StructType):
    """Select ``schema``'s columns in order and type; columns ``df`` lacks become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
