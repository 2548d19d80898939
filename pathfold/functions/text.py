"""Redaction and error classification of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# What is masked and by what.  The blank class lists the Unicode spaces too.
BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SECRET = (
    r"(?i)(authorization|bearer|token|secret|password|credential|access[_-]?key)[=: ]+"
    rf"[^{BLANK},;]+"
)
URL = rf"(?i)https?://[^{BLANK})]+"
LOCAL_PATH = rf"(?i)(?:file://)?/?(?:Users|home)/[^{BLANK})]+"
QUERY_ERRORS = r"(?i)(Parser Error|Binder Error|Catalog Error|syntax error)"
FAILURE = "DuckDB failure"


def redact(c, limit: int | None = None) -> Column:
    """Mask secrets, then URLs, then local paths; ``limit`` bounds the result's length."""
    masked = F.regexp_replace(col(c), SECRET, "$1=[redacted]")
    masked = F.regexp_replace(masked, URL, "[url]")
    masked = F.regexp_replace(masked, LOCAL_PATH, "[local-path]")
    return masked if limit is None else F.substring(masked, 1, limit)


def classify_error(operation, message) -> Column:
    """``query`` for a user's SQL mistake while executing, else ``unexpected``."""
    mistake = (col(operation) == "execute") & col(message).rlike(QUERY_ERRORS)
    return F.when(mistake, "query").otherwise("unexpected")


def first_error_line(message, marker: str = "DuckDB error:", limit: int | None = None) -> Column:
    """First non-empty line after the last marker, redacted."""
    detail = F.substring_index(col(message), marker, -1)
    lines = F.filter(
        F.split(F.regexp_replace(detail, rf"^[{BLANK}]+|[{BLANK}]+$", ""), "\n"), lambda x: x != ""
    )
    return redact(F.coalesce(F.get(lines, F.lit(0)), F.lit(FAILURE)), limit)


def failure_detail(message, limit: int | None = None) -> Column:
    """Last quoted schema error of a trace, else its last line."""
    lines = F.split(F.regexp_replace(col(message), r"\r?\n$", ""), r"\r?\n")
    quoted = F.filter(lines, lambda x: F.contains(x, F.lit('"error":')))
    picked = F.regexp_extract(F.trim(F.get(quoted, F.size(quoted) - 1)), r'"error":(.*)$', 1)
    stripped = F.regexp_replace(F.trim(picked), r'^[,"]+|[,"]+$', "")
    plain = F.get(lines, F.size(lines) - 1)
    detail = F.when(F.size(quoted) > 0, stripped).otherwise(plain)
    return detail if limit is None else F.substring(detail, 1, limit)
