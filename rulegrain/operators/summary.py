"""Counts, summaries and the severity threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.functions import missing_if_falsy
from rulegrain.operators.results import primary
from rulegrain.schema import SEVERITIES, label, parse_severity


def by_severity(violations: DataFrame) -> DataFrame:
    """severity, label and n, from the worst; severities without violations are absent."""
    return violations.groupBy("severity").agg(F.count("*").alias("n")).select("severity", label(F.col("severity")).alias("label"), "n").orderBy("severity")


def by_engine(violations: DataFrame, engines: DataFrame) -> DataFrame:
    """engine and n for every engine, 0 included."""
    counts = violations.groupBy("engine").agg(F.count("*").alias("n"))
    return engines.select("engine").distinct().join(counts, "engine", "left").select("engine", F.coalesce("n", F.lit(0)).alias("n"))


def totals(violations: DataFrame) -> DataFrame:
    """n_violations and n_files: distinct files of primary locations; missing ones don't count."""
    return violations.agg(F.count("*").alias("n_violations"), F.count_distinct(missing_if_falsy(primary()["file"], "")).alias("n_files"))


def exceeding(violations: DataFrame, threshold: int) -> DataFrame:
    """n: violations at or beyond the threshold; worst: their lowest severity number, or null."""
    hit = F.col("severity") <= threshold
    return violations.agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("severity"))).alias("worst"))


@dataclass(frozen=True)
class Gate:
    failed: bool
    exit_code: int
    n: int


def gate(violations: DataFrame, threshold: int | str | None) -> Gate:
    """No threshold passes; else the exit code is the worst severity found, 0 if none."""
    if threshold is None:
        return Gate(False, 0, 0)
    r = exceeding(violations, parse_severity(threshold)).first()
    return Gate(r.n > 0, r.worst or 0, r.n)


def before_lines(log: str | None) -> list[str]:
    """What is said before a run begins: where its log goes."""
    return ["Log goes to:", f"    {log}"] if log else ["No log is kept"]


def results_lines(violations: DataFrame, files: list[str] = (), log: str | None = None) -> list[str]:
    """The summary after a run, as lines. One aggregation; what comes to the driver is one row."""
    counts = [F.count_if(F.col("severity") == n).alias(str(n)) for n in SEVERITIES]
    r = violations.agg(F.count("*").alias("all"), F.count_distinct(missing_if_falsy(primary()["file"], "")).alias("files"), *counts).first()
    lines = [f"Violations: {r['all']} in {r['files']} files" if r["all"] else "Violations: 0"]
    lines += [f"    {r[str(n)]} {name}" for n, name in SEVERITIES.items() if r[str(n)]]
    lines += ["Results written to:", *(f"    {f}" for f in files)] if files else []
    return lines + ([f"Log: {log}"] if log else [])


def rules_lines(rules: DataFrame, files: list[str] = (), log: str | None = None) -> list[str]:
    """The summary after a listing: rules and engines, then rules of each engine."""
    per = rules.groupBy("engine").agg(F.min("engine_ord").alias("o"), F.count("*").alias("n")).orderBy("o", "engine").collect()
    lines = [f"Rules: {sum(r.n for r in per)} from {len(per)} engines"] + [f"    {r.n} {r.engine}" for r in per]
    lines += ["Rules written to:", *(f"    {f}" for f in files)] if files else []
    return lines + ([f"Log: {log}"] if log else [])
