"""Engines as table functions, for what no pattern of one line can find.

A handler is a Python UDTF: it gets rows with one value of its key, in order, and
yields findings (rule, message, file, line, end_line). Its `analyze` states the
output and by which columns the input is partitioned and ordered, so
Spark shuffles rows to it as `TABLE(...) PARTITION BY` asks; no handler sees more
than a row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from rulegrain.schema import DEFAULT_TAG, LOCATION, VIOLATIONS

FINDINGS = StructType().add("rule", StringType()).add("message", StringType()).add("file", StringType()).add("line", IntegerType()).add("end_line", IntegerType()).add("other_file", StringType()).add("other_line", IntegerType())


@dataclass
class TableEngine:
    """rules: (name, severity, tags, description, urls) of each; shaped: files to the handler's input table, which has a column `rule`."""

    name: str
    rules: list[tuple]
    handler: type
    shaped: Callable[[DataFrame], DataFrame]
    settings: list[tuple] = field(default_factory=list)

    def describe(self, spark, files) -> list[tuple]:
        return self.rules

    def fields(self) -> list[tuple]:
        return self.settings

    def run(self, rules: list, files: DataFrame) -> DataFrame:
        spark = files.sparkSession
        mine = [r[0] for r in self.rules if r[0] in set(rules)]
        if not mine:
            return spark.createDataFrame([], VIOLATIONS).drop("violation_ord")
        name = f"rulegrain_{self.name}"
        spark.udtf.register(name, F.udtf(self.handler))
        found = spark.sql(f"SELECT * FROM {name}(TABLE({{rows}}))", rows=self.shaped(files).where(F.col("rule").isin(mine)))
        place = lambda file, line, end: F.struct(file.alias("file"), line.alias("start_line"), F.lit(1).alias("start_column"), end.alias("end_line"), F.lit(None).cast("int").alias("end_column"), F.lit(None).cast("string").alias("comment"))
        size = F.col("end_line") - F.col("line")
        both = F.array(place(F.col("file"), F.col("line"), F.col("end_line")), place(F.col("other_file"), F.col("other_line"), F.col("other_line") + size))
        return found.select(F.lit(self.name).alias("engine"), "rule", "message", both.cast(f"array<{LOCATION}>").alias("code_locations"), F.lit(0).alias("primary_location_index"), F.array().cast("array<string>").alias("resource_urls"))


class Repeated:
    """Of the places of a block, in order of file and line, with its first place of all: each that is in another file, the first of that file only."""

    def __init__(self) -> None:
        self.file = None

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the blocks must be a table")
        return AnalyzeResult(schema=FINDINGS, partitionBy=[PartitioningColumn("rule"), PartitioningColumn("block"), PartitioningColumn("salt")], orderBy=[OrderingColumn("file"), OrderingColumn("line")])

    def eval(self, row) -> Iterator[tuple]:
        first = row["first"]
        if row["file"] not in (first["file"], self.file):
            self.file = row["file"]
            yield row["rule"], f"These lines are also in {first['file']}", row["file"], row["line"], row["end_line"], first["file"], first["line"]


def duplicate_blocks(lines: int = 3, name: str = "duplicates", salts: int = 64) -> TableEngine:
    """An engine that finds runs of `lines` lines, none of them blank, that stand in an earlier file too (by name).

    The first place of a block comes from an aggregation that runs in the map
    tasks first, and joins back: so a block that a third of all files hold is dealt
    over `salts` partitions, and none has to see all of its places. Blocks of
    one file alone never leave the join.
    """

    def shaped(files: DataFrame) -> DataFrame:
        rows = F.split("content", "\n")
        window = F.transform(F.sequence(F.lit(0), F.size("__l") - lines), lambda k: F.slice("__l", k + 1, F.lit(lines)))
        split = files.select("file", rows.alias("__l")).where(F.size("__l") >= lines)
        each = split.select("file", F.posexplode(window).alias("at", "text")).where(~F.exists("text", lambda x: F.trim(x) == ""))
        blocks = each.select(F.sha2(F.array_join("text", "\n"), 256).alias("block"), "file", (F.col("at") + 1).alias("line"))
        first = blocks.groupBy("block").agg(F.min(F.struct("file", "line")).alias("first"), F.max("file").alias("last")).where("last <> first.file").drop("last")
        shared = blocks.join(first, "block")
        return shared.select(F.lit("repeated_block").alias("rule"), "block", F.pmod(F.xxhash64("file"), F.lit(salts)).alias("salt"), "file", "line", (F.col("line") + lines - 1).alias("end_line"), "first")

    rules = [("repeated_block", 4, [DEFAULT_TAG, "Design"], f"{lines} lines that an earlier file has too", [])]
    return TableEngine(name, rules, Repeated, shaped, [("lines", "How many lines make a block.", "number", str(lines))])
