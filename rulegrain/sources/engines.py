"""Engines: providers of rules and of violations; the regex engine.

Regex rules of all engines run in one pass over the files. A literal index (one
Aho-Corasick automaton over the substrings that the patterns require) reads each
file once, whatever the number of rules, and hands on lines with the rules that
may match there; only those lines meet a regular expression.
"""

from __future__ import annotations

import importlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from rulegrain.schema import DEFAULT_TAG, RULES, VIOLATIONS, parse_severity
from rulegrain.sources.factors import required


class Engine(Protocol):
    name: str

    def describe(self, spark: SparkSession, files: DataFrame | None) -> list[tuple]:
        """(rule, severity, tags, description, urls) of each rule; may depend on the files."""

    def run(self, rules: list, files: DataFrame) -> DataFrame:
        """Violations of the given rules in files (file, ext, content), as VIOLATIONS without violation_ord."""

    def fields(self) -> list[tuple]:
        """(field, description, value_type, default_json) of each setting."""


#: Look-around and other groups, absolute anchors, possessive quantifiers and carriage returns.
LINE_ONLY = re.compile(r"\(\?(?![imu]*s?[imu]*\)|:)|\\[AzZGRr]|[*+?}]\+|\r")


@dataclass(frozen=True)
class RegexRule:
    name: str
    pattern: str
    extensions: tuple[str, ...] = ()
    severity: int = 3
    tags: tuple[str, ...] = (DEFAULT_TAG,)
    description: str = ""
    urls: tuple[str, ...] = ()
    message: str | None = None
    every: bool = True  # all matches of a line, or its first


def regex_literal(text: str) -> str:
    """`/pattern/flags` as a Java pattern; g, all matches of a line, is no part of it."""
    m = re.fullmatch(r"/(.+)/([a-z]*)", text, re.S)
    if not m:
        raise ValueError(f"{text!r} is no /pattern/flags")
    if bad := set(m[2]) - set("gimsu"):
        raise ValueError(f"{text!r}: unknown flags {sorted(bad)}")
    flags = "".join(f for f in "ims" if f in m[2])
    return f"(?{flags}){m[1]}" if flags else m[1]


@dataclass
class RegexEngine:
    """Line-wise patterns. One violation for each match of a line, or, for a rule without `every`, for its first.

    Columns count code points from 1; the end column is the one after the match.
    """

    rules: list[RegexRule] = field(default_factory=list)
    name: str = "regex"

    @classmethod
    def from_config(cls, custom: dict, name: str = "regex") -> RegexEngine:
        """custom: name to {regex, file_extensions, description, severity?, tags?}."""
        made = [RegexRule(n, regex_literal(c["regex"]), tuple(e.lstrip(".").lower() for e in c.get("file_extensions", ())), parse_severity(c.get("severity", 3)), tuple(c.get("tags", (DEFAULT_TAG,))), c.get("description", ""), every="g" in c["regex"].rpartition("/")[2]) for n, c in custom.items()]
        return cls(made, name)

    def describe(self, spark: SparkSession, files: DataFrame | None) -> list[tuple]:
        return [(r.name, r.severity, list(r.tags), r.description, list(r.urls)) for r in self.rules]

    def fields(self) -> list[tuple]:
        return [("custom_rules", "Rules by pattern: name to regex, file_extensions, description, severity and tags.", "object", "{}")]

    def run(self, rules: list, files: DataFrame) -> DataFrame:
        wanted = set(rules)
        return matched([(self.name, r) for r in self.rules if r.name in wanted], files)


CANDIDATES = "rule int, file string, at int, line string"
#: Characters of lines that a task holds before it hands them on.
HELD = 4 << 20


class LiteralIndex:
    """The required literals of many rules, found in one pass over a text.

    rules: (literals or None, extensions) of each. A rule without literals is a candidate
    on every line of a file that is named for it.
    """

    def __init__(self, rules: list[tuple[list[str] | None, tuple[str, ...]]]):
        import ahocorasick

        self.extensions = [frozenset(e) for _, e in rules]
        by: dict[str, list[int]] = {}
        for k, (literals, _) in enumerate(rules):
            for text in literals or ():
                by.setdefault(text, []).append(k)
        self.words = ahocorasick.Automaton()
        for text, ks in by.items():
            self.words.add_word(text, tuple(ks))
        if by:
            self.words.make_automaton()

    def applies(self, rule: int, ext: str) -> bool:
        return not self.extensions[rule] or ext in self.extensions[rule]

    def candidates(self, content: str, ext: str, everywhere: list[int]) -> list[tuple[int, int, str]]:
        """(rule, line number from 0, line) in order."""
        low, hits = content.lower(), set()
        lines = starts = None
        for end, ks in self.words.iter(low) if len(self.words) else ():
            if any(self.applies(k, ext) for k in ks):
                if starts is None:
                    starts = [0, *accumulate(len(x) + 1 for x in low.split("\n"))]
                at = bisect_right(starts, end) - 1
                hits |= {(k, at) for k in ks if self.applies(k, ext)}
        if hits or everywhere:
            lines = content.split("\n")
            hits |= {(k, at) for k in everywhere for at in range(len(lines))}
        return [(k, at, lines[at]) for k, at in sorted(hits)]


def _candidates(rules: list[tuple[list[str] | None, tuple[str, ...]]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = LiteralIndex(rules)

        def batch_of(rows: list) -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])  # of one rule after another: its pattern is compiled once
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["rule", "file", "at", "line"])

        for batch in batches:
            rows, size = [], 0
            columns = (batch.column(c) for c in ("file", "ext", "content", "everywhere"))
            for file, ext, content, everywhere in ([x.as_py() for x in row] for row in zip(*columns, strict=True)):  # one content at a time
                for k, at, line in index.candidates(content or "", ext or "", everywhere or []):
                    rows.append((k, file, at, line))
                    size += len(line) + 50
                if size > HELD:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return run


@F.pandas_udf(ArrayType(IntegerType()))
def begins(pieces: pd.Series, matches: pd.Series) -> pd.Series:
    """Where matches begin, from the lengths of the matches and of the pieces that end with them.

    After an empty piece the search goes on one character later; an empty match
    after other text comes a second time as an empty piece, which doesn't count.
    """
    import numpy as np

    def one(long, short):
        if len(long) == len(short) and (len(short) < 2 or (short > 0).all()):
            return np.cumsum(long, dtype=np.int32) - short
        out, at, k = [], 0, 0
        for size in short.tolist():
            at += int(long[k])
            out.append(at - size)
            if not size:
                if long[k] and k + 1 < len(long) and not long[k + 1]:
                    k += 1
                at += 1
            k += 1
        return np.array(out, np.int32)

    return pd.Series([one(long, short) for long, short in zip(pieces, matches, strict=True)], dtype=object)


def places(candidates: DataFrame, pattern: Column, every: Column) -> DataFrame:
    """candidates (with `line`) with column and size (code points, from 1) of each match of the pattern in its line, or of the first.

    Both arrays are extracted once a line. The pattern keeps its own groups, and
    their numbers: a whole match is group 0, a piece the text from one match's end to
    the next one's. Pieces are anchored at that end, so what follows the last match is
    read once; only where an empty match would end the chain of pieces are they free.
    """
    lengths = lambda p: F.transform(F.regexp_extract_all("line", p, F.lit(0)), lambda x: F.length(x))
    found = candidates.withColumn("__sizes", lengths(pattern)).where(F.size("__sizes") > 0)
    piece = F.concat(F.lit("(?s:.*?)(?:"), pattern, F.lit(")"))
    found = found.withColumn("__pieces", F.when(F.exists("__sizes", lambda n: n == 0), lengths(piece)).otherwise(lengths(F.concat(F.lit(r"\G"), piece))))
    found = found.withColumn("__begins", begins("__pieces", "__sizes"))
    hit = F.arrays_zip(F.col("__begins").alias("begin"), F.col("__sizes").alias("size"))
    hit = F.when(every, hit).otherwise(F.slice(hit, 1, 1))
    out = found.select(*candidates.columns, F.explode(hit).alias("__hit"))
    return out.select(*candidates.columns, (F.col("__hit.begin") + 1).alias("column"), F.col("__hit.size").alias("size"))


def as_violations(found: DataFrame, engine: Column, rule: Column, message: Column) -> DataFrame:
    """Rows (file, at, column, size) as VIOLATIONS without violation_ord."""
    line = (F.col("at") + 1).cast("int")
    place = F.struct(F.col("file").alias("file"), line.alias("start_line"), F.col("column").cast("int").alias("start_column"), line.alias("end_line"), (F.col("column") + F.col("size")).cast("int").alias("end_column"), F.lit(None).cast("string").alias("comment"))
    return found.select(engine.alias("engine"), rule.alias("rule"), message.alias("message"), F.array(place).alias("code_locations"), F.lit(0).alias("primary_location_index"), F.array().cast("array<string>").alias("resource_urls"))


def matched(rules: list[tuple[str, RegexRule]], files: DataFrame) -> DataFrame:
    """Violations of regex rules (engine, rule) of any engines: one scan of the files, no join, no regular expression for each rule and line.

    A rule whose pattern requires no literal is tried on the whole content first,
    unless it can tell a line's end from a line break, and then on that file's lines.
    """
    spark = files.sparkSession
    if not rules:
        return spark.createDataFrame([], VIOLATIONS).drop("violation_ord")
    literals = [required(r.pattern) for _, r in rules]

    def open_(k: int, r: RegexRule) -> Column:
        hit = F.lit(True) if LINE_ONLY.search(r.pattern) else F.col("content").rlike(f"(?m){r.pattern}")
        return F.when((F.col("ext").isin(*r.extensions) & hit) if r.extensions else hit, F.lit(k))

    everywhere = [open_(k, r) for k, (_, r) in enumerate(rules) if literals[k] is None]
    tried = F.array_compact(F.array(*everywhere)) if everywhere else F.array().cast("array<int>")
    read = files.select("file", "ext", "content", tried.alias("everywhere"))
    lines = read.mapInArrow(_candidates([(x, r.extensions) for x, (_, r) in zip(literals, rules, strict=True)]), CANDIDATES)
    of = lambda values: F.get(F.lit(values), F.col("rule"))  # noqa: E731  a list of all rules' values, folded to a literal
    found = places(lines, of([r.pattern for _, r in rules]), of([r.every for _, r in rules]))
    return as_violations(found, of([e for e, _ in rules]), of([r.name for _, r in rules]), of([r.message or r.description or r.name for _, r in rules]))


@dataclass
class Registry:
    """Engines in order of registration."""

    engines: list[Engine] = field(default_factory=list)

    def add(self, engine: Engine) -> Registry:
        if any(e.name == engine.name for e in self.engines):
            raise ValueError(f"engine {engine.name!r} is there already")
        self.engines.append(engine)
        return self

    def load(self, *modules: str) -> Registry:
        """Modules with a function engines(); a failure ends the action."""
        for m in modules:
            for e in importlib.import_module(m).engines():
                self.add(e)
        return self

    def without(self, disabled: list[str]) -> Registry:
        return Registry([e for e in self.engines if e.name not in disabled])

    def names(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.name, k) for k, e in enumerate(self.engines)], "engine string, engine_ord int")

    def catalogue(self, spark: SparkSession, files: DataFrame | None = None) -> DataFrame:
        rows = [(e.name, k, rule, i, severity, tags, text, urls) for k, e in enumerate(self.engines) for i, (rule, severity, tags, text, urls) in enumerate(e.describe(spark, files))]
        return spark.createDataFrame(rows, RULES)

    def run(self, selected: DataFrame, files: DataFrame, seen: Observation | None = None) -> DataFrame:
        """Violations of all engines with a selected rule, one plan; engines without are left out.

        The regex engines share one scan. seen: observes the number of `files` in it.

        selected: rules (a catalogue's rows: small by nature).
        """
        names: dict[str, list[str]] = {}
        for r in selected.select("engine", "rule").collect():
            names.setdefault(r.engine, []).append(r.rule)
        mine = [e for e in self.engines if e.name in names]
        regex = [(e.name, r) for e in mine if type(e) is RegexEngine for r in e.rules if r.name in set(names[e.name])]
        out = matched(regex, files.observe(seen, F.count(F.lit(1)).alias("files")) if seen and regex else files)
        for e in mine:
            if type(e) is not RegexEngine:
                out = out.unionByName(e.run(names[e.name], files))
        return out.withColumn("violation_ord", F.monotonically_increasing_id())


def documented(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue from Markdown pages, one for each rule: a title line, and a line `Label (n)`.

    The number is read, never the label.
    """
    pages = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("page"))
    name = F.regexp_extract("value", r"^#*\s*(\S[^\n]*?)\s*(?:\[.*)?\n", 1)
    return pages.select("page", name.alias("rule"), F.regexp_extract("value", r"(?m)^\W*[A-Z][a-z]+ \(([1-5])\)\s*$", 1).try_cast("int").alias("severity"))
