"""Schemas of the model's relations, and its fixed level names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = "struct<file:string,start_line:int,start_column:int,end_line:int,end_column:int,comment:string>"
RULES = "engine string, engine_ord int, rule string, rule_ord int, severity int, tags array<string>, description string, resource_urls array<string>"
OVERRIDES = "engine string, rule string, severity int, tags array<string>"
VIOLATIONS = f"violation_ord bigint, engine string, rule string, message string, code_locations array<{LOCATION}>, primary_location_index int, resource_urls array<string>"
FILES = "file string, ext string, is_target boolean, content string"
FIELDS = "engine string, field string, field_ord int, description string, value_type string, default_json string, value_json string, supplied boolean"
LOG_EVENTS = "ts timestamp, source string, level int, message string"
SELECTION_PROGRESS = "ts timestamp, seq bigint, core_idx int, percent double"
RUN_PROGRESS = "ts timestamp, seq bigint, engine string, percent double, message string"
TELEMETRY = "ts timestamp, source string, event string, data map<string,string>"

SEVERITIES = {1: "Critical", 2: "High", 3: "Moderate", 4: "Low", 5: "Info"}
LOG_LEVELS = {1: "Error", 2: "Warn", 3: "Info", 4: "Debug", 5: "Fine"}
DEFAULT_LOG_LEVEL = 4
DEFAULT_TAG = "Recommended"


def _level(value: int | str, names: dict[int, str], what: str) -> int:
    """A level from its number or its name in any case."""
    text = str(value).strip().lower()
    for number, name in names.items():
        if text in (str(number), name.lower()):
            return number
    allowed = ", ".join(f"{k} ({v})" for k, v in names.items())
    raise ValueError(f"{value!r} is no {what}; use one of {allowed}")


def parse_severity(value: int | str) -> int:
    return _level(value, SEVERITIES, "severity")


def parse_log_level(value: int | str) -> int:
    return _level(value, LOG_LEVELS, "log level")


def label(level: Column, names: dict[int, str] = SEVERITIES) -> Column:
    """The level's name; a level outside the list fails the query."""
    out = F.raise_error(F.concat(F.lit("no such level: "), F.coalesce(level.cast("string"), F.lit("null")))).cast("string")
    for number, name in names.items():
        out = F.when(level == number, F.lit(name)).otherwise(out)
    return out


def severity_label(level: Column) -> Column:
    """`2 (High)`."""
    return F.concat(level.cast("string"), F.lit(" ("), label(level), F.lit(")"))


def severity_of(text: Column) -> Column:
    """A severity column from numbers or names in any case; others fail the query."""
    out = F.raise_error(F.concat(F.lit("no such severity: "), text)).cast("int")
    for number, name in SEVERITIES.items():
        out = F.when(F.lower(F.trim(text)).isin(str(number), name.lower()), F.lit(number)).otherwise(out)
    return F.when(text.isNotNull(), out)
