"""Violations: enrichment, order, numbers, locations and projections."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.functions import base_name, dir_name, header, indented, missing_if_falsy, properties, without_prefix
from rulegrain.schema import severity_label


def enriched(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations with their rule's severity, tags and resources; the rule's URLs come first.

    Catalyst broadcasts the rules by their size where they are small.
    """
    mine = rules.select("engine", "rule", "severity", "tags", F.col("resource_urls").alias("__urls"))
    none = F.array().cast("array<string>")
    return violations.join(mine, ["engine", "rule"]).withColumn("resource_urls", F.concat(F.coalesce("__urls", none), F.coalesce("resource_urls", none))).drop("__urls")


def primary(locations: str = "code_locations", index: str = "primary_location_index") -> Column:
    return F.get(F.col(locations), F.col(index))


def sort_columns(collation: str | None = "UNICODE") -> list[Column]:
    """Severity, then the primary location's file, line and column (missing ones first), then the
    order of arrival, which makes the sort stable."""
    at = primary()
    file = F.coalesce(at["file"], F.lit(""))
    return [F.col("severity"), F.collate(file, collation) if collation else file, F.coalesce(at["start_line"], F.lit(0)), F.coalesce(at["start_column"], F.lit(0)), F.col("violation_ord")]


def ordered(violations: DataFrame, collation: str | None = "UNICODE") -> DataFrame:
    return violations.orderBy(*sort_columns(collation))


def most_severe(violations: DataFrame, n: int, collation: str | None = "UNICODE") -> DataFrame:
    """The first n in order: a top-n, not a full sort."""
    return ordered(violations, collation).limit(n)


def numbered(violations: DataFrame, collation: str | None = "UNICODE") -> DataFrame:
    """`num` from 1 in order, without gathering the rows, or those of a severity or file, in one task.

    Rows are dealt by ranges of the whole sort key, so many rows with one
    severity, file or place still spread; each partition is sorted and numbered for
    itself, and what stands before it is the sum of the other partitions' counts: one
    number for each partition passes the driver. The ordered rows are kept (in memory
    or on disk, made again where lost), so that counting and reading see the same.
    """
    spark = violations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = sort_columns(collation)
    ranged = violations.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # in a partition this id counts from 0; its upper bits tell the partition
    kept = ranged.withColumn("__id", F.monotonically_increasing_id()).persist()
    part, nth = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r.n for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = [0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=0) + 1))]
    return kept.withColumn("num", F.get(F.lit(before).cast("array<bigint>"), part) + nth + 1).drop("__id")


def location_text(at: Column, run_dir: Column | None = None) -> Column:
    """`file (line:column-endline:endcolumn) "comment"`; columns default to 1, an end needs its line."""
    file = F.coalesce(at["file"], F.lit(""))
    file = without_prefix(file, run_dir) if run_dir is not None else file
    line, end = missing_if_falsy(at["start_line"], 0), missing_if_falsy(at["end_line"], 0)
    column = lambda c: F.coalesce(missing_if_falsy(at[c], 0), F.lit(1)).cast("string")
    stop = F.when(end.isNotNull(), F.concat(F.lit("-"), end.cast("string"), F.lit(":"), column("end_column"))).otherwise(F.lit(""))
    place = F.when(line.isNotNull(), F.concat(F.lit(" ("), line.cast("string"), F.lit(":"), column("start_column"), stop, F.lit(")"))).otherwise(F.lit(""))
    comment = missing_if_falsy(at["comment"], "")
    return F.concat(file, place, F.when(comment.isNotNull(), F.concat(F.lit(' "'), comment, F.lit('"'))).otherwise(F.lit("")))


def location_texts(run_dir: Column | None = None) -> Column:
    """All locations of a violation as text; the primary one of several is marked."""
    several = F.size("code_locations") > 1
    return F.transform("code_locations", lambda x, i: F.concat(F.when(several & (i == F.col("primary_location_index")), F.lit("(main) ")).otherwise(F.lit("")), location_text(x, run_dir)))


def one_or_many(values: Column, one: str, many: str) -> list[Column]:
    """Two columns: the only value, or all of several; null where they don't apply."""
    return [F.when(F.size(values) == 1, F.get(values, 0)).alias(one), F.when(F.size(values) > 1, values).alias(many)]


def details(violations: DataFrame, run_dir: Column | None = None, collation: str | None = "UNICODE") -> DataFrame:
    """num, title, severity, engine, message, location or locations, resource or resources."""
    title = F.concat("engine", F.lit(":"), "rule").alias("title")
    return numbered(violations, collation).select(
        "num", title, severity_label(F.col("severity")).alias("severity"), "engine", "rule", "message",
        *one_or_many(location_texts(run_dir), "location", "locations"), *one_or_many(F.col("resource_urls"), "resource", "resources"),
    )


def detail_text(details: DataFrame) -> DataFrame:
    """(num, text): each row of details() as a header and, below it, its properties; what it doesn't have is left out."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"), F.lit(None).cast("array<string>").alias("values")))
    many = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.lit(None).cast("string").alias("value"), F.col(c).alias("values")))
    pairs = F.array_compact(F.array(one("severity"), one("engine"), one("message"), one("location"), many("locations"), one("resource"), many("resources")))
    title = header(F.concat(F.col("num").cast("string"), F.lit(". "), "rule"))
    return details.select("num", F.concat(title, F.lit("\n"), indented(properties(pairs))).alias("text"))


def table_text(rows: DataFrame) -> DataFrame:
    """(num, text): each row of table(), or of rule_table(), as one line, its columns between bars; null is empty."""
    return rows.select("num", F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), " | ").alias("text"))


def table(violations: DataFrame, collation: str | None = "UNICODE") -> DataFrame:
    """num, severity, rule, location, message; paths are relative to the files' common folder.

    A location without line or column has none in the text's place: null, not the word.
    """
    rows = numbered(violations, collation)
    folder = rows.agg(common_parent(primary()["file"]).alias("__folder"))  # of the kept rows: nothing is computed again
    at = primary()
    short = F.when(F.col("__folder").isin("", "/"), at["file"]).otherwise(without_prefix(at["file"], F.concat("__folder", F.lit("/"))))
    line = F.concat_ws(":", short, at["start_line"], at["start_column"])
    return rows.join(F.broadcast(folder)).select("num", severity_label(F.col("severity")).alias("severity"), F.concat("engine", F.lit(":"), "rule").alias("rule"), F.when(at["start_line"].isNotNull() & at["start_column"].isNotNull(), line).alias("location"), "message")


def rule_details(rules: DataFrame) -> DataFrame:
    """num, rule, severity, engine, tags, resource or resources, description; empty ones null."""
    # a catalogue is small by nature: one ordered window
    num = F.row_number().over(Window.orderBy("engine_ord", "engine", "rule"))
    return rules.select(
        num.alias("num"), "rule", severity_label(F.col("severity")).alias("severity"), "engine",
        F.when(F.size("tags") > 0, F.array_join("tags", ", ")).alias("tags"),
        *one_or_many(F.col("resource_urls"), "resource", "resources"), missing_if_falsy(F.col("description"), "").alias("description"),
    )


def rule_table(rules: DataFrame) -> DataFrame:
    num = F.row_number().over(Window.orderBy("engine_ord", "engine", "rule"))
    return rules.select(num.alias("num"), F.col("rule").alias("name"), "engine", severity_label(F.col("severity")).alias("severity"), F.array_join("tags", ", ").alias("tag"))


def common_parent(file: Column) -> Column:
    """Aggregate: the longest folder that all files share; '' if their roots differ or there are none.

    Folders are compared as arrays of names: what the least and the greatest
    share at the start, all share.
    """
    parts = F.split(F.when(file != "", dir_name(file)), "/")
    parts = F.when(dir_name(file) == "/", F.array(F.lit(""))).otherwise(parts)
    low, high = F.min(parts), F.max(parts)
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    cut = F.coalesce(F.array_position(same, False).cast("int"), F.lit(0))
    many = F.when(cut > 0, cut - 1).otherwise(F.size(same))
    shared = F.slice(low, 1, F.greatest(many, F.lit(0)))
    text = F.array_join(shared, "/")
    return F.coalesce(F.when((many == 1) & (F.get(low, 0) == ""), F.lit("/")).otherwise(text), F.lit(""))


def file_name(at: Column) -> Column:
    return base_name(at["file"])
