"""Results as one document (JSON, SARIF, HTML), written by tasks.

A Python data source whose write tasks stream their rows, already text, into part
files in the shared folder; the commit writes the document's header, the
parts in the order of their partitions, and its footer. So a result of any size
passes no driver row by row, and an attempt that fails leaves nothing in the
document: only parts whose tasks committed are joined. The file at `path`
appears as a whole, or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rulegrain.operators.results import sort_columns
from rulegrain.sources.shared import filesystem, shared_path

FORMAT = "rule_document"
#: One run of rows of a partition: the tool (SARIF) or nothing, and the rules met.
ROWS = "tool string, rule string, text string"
COPIED = 1 << 20
HTML_HEAD = "<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>Violations</title></head><body><table>\n"
HTML_TAIL = "</table></body></html>\n"
SARIF_HEAD = '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": ['
#: Severity to SARIF's level.
SARIF_LEVEL = {1: "error", 2: "error", 3: "warning", 4: "note", 5: "note"}


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: for each tool its file and the rules in it."""

    partition: int = 0
    files: dict[str, str] = field(default_factory=dict)
    rules: dict[str, list[str]] = field(default_factory=dict)


class DocumentWriter(DataSourceWriter):
    """Options: path, kind (json, sarif, html), parts (a folder that all tasks reach), head (HTML: the header row)."""

    def __init__(self, options: dict):
        self.path, self.kind, self.parts, self.head = options["path"], options["kind"], options["parts"], options.get("head", "")
        self.between = "\n" if self.kind == "html" else ",\n"

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, folder = filesystem(self.parts)
        fs.create_dir(folder, recursive=True)
        files: dict[str, str] = {}
        rules: dict[str, set] = {}
        open_: dict[str, object] = {}
        try:
            for row in iterator:
                tool = row.tool or ""
                if tool not in open_:
                    files[tool] = f"{folder}/{task.partitionId():06}-{task.taskAttemptId()}-{len(open_)}"
                    open_[tool], rules[tool] = fs.open_output_stream(files[tool]), set()
                else:
                    open_[tool].write(self.between.encode())
                open_[tool].write(row.text.encode())
                if row.rule is not None:
                    rules[tool].add(row.rule)
        finally:
            for f in open_.values():
                f.close()
        return Part(task.partitionId(), files, {t: sorted(r) for t, r in rules.items()})

    def commit(self, messages: list) -> None:
        from uuid import uuid4

        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        source, folder = filesystem(self.parts)
        target, path = filesystem(self.path)
        draft = f"{path}.{uuid4().hex}"
        with target.open_output_stream(draft) as out:
            say = lambda text: out.write(text.encode())

            def joined(tool: str) -> None:
                for k, name in enumerate(p.files[tool] for p in parts if tool in p.files):
                    say(self.between if k else "")
                    with source.open_input_stream(name) as f:
                        while chunk := f.read(COPIED):
                            out.write(chunk)

            if self.kind == "json":
                say('{"violations": [\n')
                joined("")
                say("\n]}\n")
            elif self.kind == "html":
                say(HTML_HEAD + self.head + "\n")
                joined("")
                say("\n" + HTML_TAIL)
            else:
                say(SARIF_HEAD)
                for k, tool in enumerate(sorted({t for p in parts for t in p.files})):
                    rules = [{"id": r} for r in sorted({r for p in parts for r in p.rules.get(tool, ())})]
                    say((", " if k else "") + json.dumps({"tool": {"driver": {"name": tool, "rules": rules}}})[:-1] + ', "results": [\n')
                    joined(tool)
                    say("\n]}")
                say("]}\n")
        target.move(draft, path)
        self._clear(source, folder)

    def abort(self, messages: list) -> None:
        self._clear(*filesystem(self.parts))

    def _clear(self, fs, folder: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class DocumentSource(DataSource):
    """The format `rule_document`; it takes rows of ROWS."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def sarif_text() -> Column:
    """A violation as a SARIF result; to_json leaves out what is null."""
    level = F.get(F.array(*[F.lit(SARIF_LEVEL[k]) for k in sorted(SARIF_LEVEL)]), F.col("severity") - 1)
    there = lambda c: F.when(c != 0, c)

    def place(at: Column) -> Column:
        region = F.struct(there(at["start_line"]).alias("startLine"), there(at["start_column"]).alias("startColumn"), there(at["end_line"]).alias("endLine"), there(at["end_column"]).alias("endColumn"))
        physical = F.struct(F.struct(F.coalesce(at["file"], F.lit("")).alias("uri")).alias("artifactLocation"), F.when(at["start_line"] != 0, region).alias("region"))
        return F.struct(physical.alias("physicalLocation"), F.when(at["comment"] != "", F.struct(at["comment"].alias("text"))).alias("message"))

    places, main = F.transform("code_locations", place), F.coalesce("primary_location_index", F.lit(0))
    return F.to_json(F.struct(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.filter(places, lambda _, k: k == main).alias("locations"), F.filter(places, lambda _, k: k != main).alias("relatedLocations"),
    ))


def html_text(columns: list[Column]) -> Column:
    """A table row; markup in values is escaped."""
    out = [F.lit("<tr>")]
    for c in columns:
        text = F.coalesce(c.cast("string"), F.lit(""))
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(plain), F.lit(entity))
        out += [F.lit("<td>"), text, F.lit("</td>")]
    return F.concat(*out, F.lit("</tr>"))


def json_text(violations: DataFrame) -> Column:
    return F.to_json(F.struct(*violations.columns), {"ignoreNullFields": "false"})


def write_document(violations: DataFrame, path: str, kind: str, flat: list[Column] = ()) -> None:
    """violations, in order, as one document at path, which is replaced.

    flat: the columns of HTML's table. Sorting is by ranges, so no task sorts more than its share.
    """
    spark: SparkSession = violations.sparkSession
    spark.dataSource.register(DocumentSource)
    text = {"json": lambda: json_text(violations), "sarif": sarif_text, "html": lambda: html_text(list(flat))}[kind]()
    tool = F.col("engine") if kind == "sarif" else F.lit(None).cast("string")
    by = sort_columns()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = violations.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(tool.alias("tool"), F.col("rule"), text.alias("text"))
    head = "<tr>" + "".join(f"<th>{n}</th>" for n in violations.select(*flat).columns) + "</tr>" if kind == "html" else ""
    rows.write.format(FORMAT).mode("append").options(path=path, kind=kind, parts=shared_path(spark, "document-parts"), head=head).save()

