"""Parse lines of any format to one record layout. Every line in gives one row out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators import detect_format
from emberlog.operators.formats import clf, jsonl, syslog, wincsv
from emberlog.operators.joins import attach
from emberlog.schema import ENTRY, LOG_FORMATS, Record
from emberlog.session import materialize
from emberlog.sources.lines import sample_lines

_registered: dict[str, Callable[[Column], Record]] = {}


def register_format(name: str, score: Callable[[Column], Column], parse: Callable[[Column], Record]) -> None:
    """Add a format: ``score(raw)`` tells whether a line fits, ``parse(raw)`` gives a ``schema.entry`` record."""
    if name in LOG_FORMATS:
        raise ValueError(f"{name} is built in")
    detect_format.register_score(name, score)
    _registered[name] = parse


def registered_names() -> list[str]:
    return list(_registered)


def unregister_format(name: str) -> None:
    detect_format._registered.pop(name, None)
    _registered.pop(name, None)


def _is_first(df: DataFrame) -> Column:
    at = F.struct("block_start", "row_id") if "row_id" in df.columns else F.struct("line_no")
    return F.coalesce(at == F.col("header_at"), F.lit(False))


def parse_lines(lines: DataFrame, fmt: str | None = None, header: list[str] | None = None,
                base_year: int = syslog.BASE_YEAR, apply_offset: bool = False) -> DataFrame:
    """Add the record columns to a table with ``raw``; no shuffle.

    With ``fmt`` all lines are read in that format. Without it the table needs a ``format`` column naming each
    line's format; ``unknown`` and other names are read as syslog, the most permissive grammar. CSV lines need a
    ``header`` (column of names as added by ``parse_corpus``, or argument: then the files have no header line).
    """
    raw = F.col("raw")
    want = F.lit(fmt) if fmt else F.col("format")
    if header is not None:
        lines = lines.withColumn("header", F.lit([h.strip() for h in header]))
    has_header = "header" in lines.columns
    first = _is_first(lines) if "header_at" in lines.columns and header is None else F.lit(False)
    wanted = [fmt] if fmt else [*LOG_FORMATS, *_registered]

    def only(name: str, value: Column) -> Column:
        return value if fmt else F.when(want == name, value)

    # One tokenising pass per format, kept as its own column so that the record fields only pick from it.
    steps = {}
    if "clf" in wanted:
        steps["_clf"] = only("clf", clf.tokens(raw))
    if "json" in wanted:
        steps["_json"] = only("json", jsonl.fields(raw))
    if "windows_csv" in wanted:
        header_col = F.col("header") if has_header else F.lit(None).cast("array<string>")
        steps["_csv"] = only("windows_csv", wincsv.tokens(raw, header_col))
    others = ["clf", "json", "windows_csv", *_registered]
    if fmt is None or fmt not in others:
        steps["_syslog"] = syslog.tokens(raw) if fmt else F.when(~want.isin(*others), syslog.tokens(raw))
    # The tokens come out of a generator of one row: filters on record fields are not pushed below it, so no filter or
    # projection above can copy the tokenising into itself and run it again.
    packed = F.struct(*[c.alias(n) for n, c in steps.items()]) if steps else F.struct(F.lit(0).alias("_none"))
    tokenised = lines.select("*", F.inline(F.array(packed)))

    parsed = {
        "clf": lambda: clf.parse(raw, F.col("_clf")),
        "json": lambda: jsonl.parse(raw, F.col("_json"), apply_offset),
        "windows_csv": lambda: wincsv.parse(raw, F.col("_csv"), first),
        **{name: (lambda p=p: p(raw)) for name, p in _registered.items()},
    }
    fallback = lambda: syslog.parse(raw, F.col("_syslog"), base_year)
    if fmt:
        fields = parsed.get(fmt, fallback)()
    else:
        records, other = {name: build() for name, build in parsed.items()}, fallback()
        fields = {}
        for f in ENTRY.fieldNames():
            choice = F.when(F.lit(False), other[f])
            for name, record in records.items():
                choice = choice.when(want == name, record[f])
            fields[f] = choice.otherwise(other[f])
    keep = [c for c in lines.columns if c not in (*ENTRY.fieldNames(), "header", "header_at", "score")]
    return tokenised.select(*keep, *[c.alias(n) for n, c in fields.items()])


def file_table(lines: DataFrame, fmt: str | None = None, dense: bool = False) -> DataFrame:
    """Per file: its format and, for CSV, the header line. One small row per file, from one pass, written once."""
    if fmt:
        files = wincsv.headers(lines, dense).withColumn("format", F.lit(fmt))
    else:
        first = F.max(F.when(F.col("sample_no") == 1, F.struct("at", "line")))
        scores = detect_format.format_scores(sample_lines(lines, dense=dense), _first=first)
        files = detect_format.best_format(scores, "_first").select(
            "source_file", "format", F.col("_first.at").alias("header_at"),
            wincsv.trimmed_fields(F.col("_first.line")).alias("header"))
    is_csv = F.col("format") == "windows_csv"
    return materialize(
        files.select(
            "source_file",
            "format",
            F.when(is_csv, F.col("header_at")).alias("header_at"),
            F.when(is_csv, F.col("header")).alias("header"),
        )
    )


def parse_corpus(lines: DataFrame, fmt: str | None = None, dense: bool = False, **options) -> DataFrame:
    """Detect each file's format and parse every line; ``fmt`` skips detection.

    ``dense``: the lines carry the numbers of ``number_lines``, which makes picking each file's first lines a filter.

    The per-file table is joined by broadcast when counted small, else by a salted join, because one file may hold
    a large share of all lines.
    """
    if fmt and (fmt != "windows_csv" or options.get("header") is not None):
        return parse_lines(lines, fmt, **options)
    return parse_lines(attach(lines, file_table(lines, fmt, dense), ["source_file"]), **options)
