"""Column functions: text, paths, time and maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_timestamp(ts: Column) -> Column:
    """`2025_02_20_14_30_18_014`, in the session's time zone."""
    return F.date_format(ts, "yyyy_MM_dd_HH_mm_ss_SSS")


def clock(ts: Column) -> Column:
    """`4:3:8`, not padded."""
    return F.date_format(ts, "H:m:s")


def iso_timestamp(ts: Column) -> Column:
    """`2025-02-20T14:30:18.014Z`; the session's time zone is to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def indented(text: Column, width: int = 4) -> Column:
    """Every line that isn't empty, moved right."""
    return F.regexp_replace(text, "(?m)^(?=.)", " " * width)


def commented(text: Column) -> Column:
    """`# ` before every line, empty ones too."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("# "), line)), "\n")


def inline_comment(text: Column, comment: Column) -> Column:
    """A comment at the end of the first line."""
    lines = F.split(text, "\n", 2)
    rest = F.when(F.size(lines) > 1, F.concat(F.lit("\n"), F.get(lines, 1))).otherwise(F.lit(""))
    return F.concat(F.get(lines, 0), F.lit("  # "), comment, rest)


def property_list(pairs: Column) -> Column:
    """Lines `key:   value` from an array of (key, value), keys padded to the longest; null without pairs is ''.

    Null and empty values leave the key alone.
    """
    width = F.array_max(F.transform(pairs, lambda p: F.length(p["key"]))) + 1
    line = lambda p: F.rtrim(F.concat(F.rpad(F.concat(p["key"], F.lit(":")), width + 1, " "), F.coalesce(p["value"], F.lit(""))))
    return F.when(F.size(F.coalesce(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"))) == 0, F.lit("")).otherwise(F.array_join(F.transform(pairs, line), "\n"))


def properties(pairs: Column) -> Column:
    """As property_list, from an array of (key, value, values): `values`, where there are some, stand below the key, a line each and moved right.

    A value's second line begins below its first.
    """
    width = F.array_max(F.transform(pairs, lambda p: F.length(p["key"]))) + 2

    def line(p: Column) -> Column:
        parts = F.split(F.coalesce(p["value"], F.lit("")), "\n", 2)
        rest = F.when(F.size(parts) > 1, F.concat(F.lit("\n"), F.repeat(F.lit(" "), width), F.get(parts, 1))).otherwise(F.lit(""))
        value = F.concat(F.get(parts, 0), rest)
        below = F.concat(p["key"], F.lit(":\n"), F.array_join(F.transform(p["values"], lambda v: indented(v)), "\n"))
        return F.when(F.size(p["values"]) > 0, below).otherwise(F.rtrim(F.concat(F.rpad(F.concat(p["key"], F.lit(":")), width, " "), value)))

    return F.array_join(F.transform(pairs, line), "\n")


def header(title: Column) -> Column:
    return F.concat(F.lit("=== "), title)


def header_and_body(title: Column, pairs: Column) -> Column:
    """A header, and under it the list of properties, moved right."""
    return F.concat(header(title), F.lit("\n"), indented(property_list(pairs)))


def dimmed(text: Column) -> Column:
    """Grey on a terminal."""
    return F.concat(F.lit("\x1b[2m"), text, F.lit("\x1b[22m"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The folder of a path; of a path at the root, `/`; without a folder, ''."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~path.contains("/"), F.lit("")).when(folder == "", F.lit("/")).otherwise(folder)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; '' if none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1))


def without_prefix(path: Column, prefix: Column) -> Column:
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def elapsed_seconds(start: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(now) - F.unix_millis(start)) / 1000)


def same_value(a: Column, b: Column) -> Column:
    """Equality of JSON texts: order of keys and elements counts; null equals null."""
    return a.eqNullSafe(b)


def missing_if_falsy(value: Column, falsy) -> Column:
    """null where a value is the type's empty one ('' or 0)."""
    return F.nullif(value, F.lit(falsy))


def merged(first: Column, *later: Column) -> Column:
    """Maps merged; a later map's value wins."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    return reduce(two, later, first)


def message(template: str, *values: Column) -> Column:
    """A printf template over columns."""
    return F.format_string(template, *values)
