"""Security-log analytics as Spark DataFrame jobs."""

from emberlog.session import configure
from emberlog.operators.parse import parse_corpus, parse_lines, register_format
from emberlog.plans.analyze import analyze
from emberlog.sources.lines import number_lines, scan_lines

__all__ = ["analyze", "configure", "number_lines", "parse_corpus", "parse_lines", "register_format", "scan_lines"]
