"""Results, rules, configuration and logs as files.

Spark writes rows (CSV, JSON lines, XML, and Parquet for large results) as
folders; documents that are one object by nature (SARIF, HTML, a JSON array)
are written by tasks in parts that a commit joins (see documents).
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.operators.results import primary
from rulegrain.plans.documents import SARIF_LEVEL, write_document
from rulegrain.schema import LOG_EVENTS, severity_label
from rulegrain.streaming.events import log_file

#: Longest first: .sarif.json is SARIF.
FORMATS = ((".sarif.json", "sarif"), (".sarif", "sarif"), (".csv", "csv"), (".html", "html"), (".htm", "html"), (".json", "json"), (".xml", "xml"), (".parquet", "parquet"))


def format_of(path: str) -> str:
    """By extension in any case; others are an error, before anything is scanned."""
    for ending, name in FORMATS:
        if path.lower().endswith(ending):
            return name
    raise ValueError(f"{path!r}: unknown extension; use one of {', '.join(e for e, _ in FORMATS)}")


def flat_columns() -> dict[str, Column]:
    """The scalar columns of a violation by name."""
    at = primary()
    own = {c: F.col(c) for c in ("engine", "rule", "severity", "message")}
    places = {c: at[c] for c in ("file", "start_line", "start_column", "end_line", "end_column")}
    more = {"n_locations": F.size("code_locations"), "resources": F.array_join("resource_urls", " ")}
    return {n: c.alias(n) for n, c in (own | places | more).items()}


def flat_rows(violations: DataFrame) -> DataFrame:
    """One row for each violation, scalar columns only."""
    return violations.select(*flat_columns().values())


def sarif_rows(violations: DataFrame) -> DataFrame:
    """One row for each location of each violation, in SARIF's terms."""
    level = F.lit(None).cast("string")
    for n, name in SARIF_LEVEL.items():
        level = F.when(F.col("severity") == n, F.lit(name)).otherwise(level)
    return violations.select(F.col("engine").alias("tool"), F.col("rule").alias("rule_id"), level.alias("level"), "message", F.posexplode_outer("code_locations").alias("location", "at")).select("tool", "rule_id", "level", "message", "location", F.col("at.file").alias("uri"), F.col("at.start_line").alias("start_line"), F.col("at.start_column").alias("start_column"))


def _json(row) -> dict:
    return row.asDict(recursive=True)


def write_results(violations: DataFrame, path: str) -> None:
    """Overwrites; the parent folder must exist; written even when empty."""
    kind = format_of(path)
    if kind in ("csv", "xml", "parquet"):
        rows = flat_rows(violations)
        if kind == "csv":
            rows.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
        elif kind == "xml":
            rows.write.mode("overwrite").option("rowTag", "violation").option("rootTag", "violations").xml(path)
        else:
            rows.write.mode("overwrite").parquet(path)
        return
    shown = [severity_label(F.col("severity")).alias("severity") if n == "severity" else c for n, c in flat_columns().items()]
    write_document(violations, path, kind, shown if kind == "html" else ())


def writers(paths: list[str]) -> list[Callable[[DataFrame], None]]:
    """One writer for each path; a bad extension fails here."""
    for p in paths:
        format_of(p)
    return [lambda violations, p=p: write_results(violations, p) for p in paths]


def rules_writer(path: str) -> Callable[[DataFrame], None]:
    """Rules go to JSON only. A catalogue is small by nature."""
    if not path.lower().endswith(".json"):
        raise ValueError(f"{path!r}: rules are written as .json")

    def write(rules: DataFrame) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"rules": [_json(r) for r in rules.collect()]}, f, indent=2)

    return write


def write_config(text: str, path: str, overwrite: Callable[[str], bool] = lambda path: True) -> bool:
    """YAML to a .yaml or .yml file; asks before it overwrites. Whether it was written."""
    if not path.lower().endswith((".yaml", ".yml")):
        raise ValueError(f"{path!r}: a configuration is written as .yaml or .yml")
    if os.path.exists(path) and not overwrite(path):
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return True


def log_name(stamp: str) -> str:
    return f"rulegrain-{stamp}.log"


LOG_END = "End of the log."


class RunLog:
    """The log of one run: its events up to the configured level, then a last line, in a file of log_folder.

    A run has a handful of events, so they are kept until close(). Without a
    folder nothing is written.
    """

    def __init__(self, folder: str | None, level: int):
        self.folder, self.level, self.events = folder, level, []
        stamp = datetime.now(timezone.utc).strftime("%Y_%m_%d_%H_%M_%S_%f")[:-3]
        self.path = os.path.join(folder, log_name(stamp)) if folder else None

    def say(self, level: int, source: str, message: str) -> None:
        self.events.append((datetime.now(timezone.utc), source, level, message))

    def close(self, spark: SparkSession) -> str | None:
        """The file's path; None where no folder is set."""
        if not self.path:
            return None
        lines = log_file(spark.createDataFrame(self.events, LOG_EVENTS), self.level).orderBy("ts") if self.events else None
        with open(self.path, "w", encoding="utf-8") as f:
            f.writelines(f"{r.text}\n" for r in (lines.collect() if lines else ()))
            f.write(LOG_END + "\n")
        return self.path
