"""Workspaces: path arguments, globs, targets and file scans."""

from __future__ import annotations

import glob
import json
import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.functions import extension
from rulegrain.operators.selector import flat
from rulegrain.sources import folders

DEFAULT = ["."]


def expand(paths: list[str] | str, root: str = ".") -> list[str]:
    """Paths with globs (`*`, `?` only) expanded to files; others stay as they are, folders too.

    A `!` anywhere is an error. Backslashes in globs are slashes. Dot files match
    only where the pattern's own segment starts with a dot.
    """
    out: list[str] = []
    for path in flat(paths):
        if "!" in path:
            raise ValueError(f"{path!r}: paths with '!' (negation) aren't supported")
        if not re.search(r"[*?]", path):
            out.append(path)
            continue
        pattern = re.sub(r"\[", "[[]", path.replace("\\", "/"))
        # ** stands alone in its segment; elsewhere it is *
        segments = [s if s == "**" else re.sub(r"\*+", "*", s) for s in pattern.split("/")]
        found = glob.glob("/".join(segments), root_dir=None if os.path.isabs(path) else root, recursive=True)
        out += sorted(f for f in found if os.path.isfile(f if os.path.isabs(f) else os.path.join(root, f)))
    return list(dict.fromkeys(out))


def resolve(workspace: list[str] | None, target: list[str] | None, scan: bool) -> tuple[list[str] | None, list[str] | None]:
    """Defaults: a scan works on the current folder; a listing on none, or on it if there are targets."""
    if not workspace:
        workspace = DEFAULT if scan or target else None
    return workspace, target or None


def tops(paths: list[str]) -> list[str]:
    """The paths less those at or under another, so that no file is read twice; local ones are absolute."""
    whole = dict.fromkeys(p.rstrip("/") if "://" in p else os.path.abspath(p) for p in paths)
    above = lambda p: (p[:k] or "/" for k, c in enumerate(p) if c == "/")
    return [p for p in whole if not any(up in whole for up in above(p) if up != p)]


def _folders(spark: SparkSession, paths: list[str], names: bool) -> DataFrame:
    spark.dataSource.register(folders.WorkspaceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": json.dumps(paths), "tasks": str(4 * spark.sparkContext.defaultParallelism), "names": str(names).lower()}
    return spark.read.format(folders.FORMAT).options(**options).load()


def scan(spark: SparkSession, paths: list[str], targets: list[str] | None = None, names: bool = False) -> DataFrame:
    """file, ext, content of all files under the paths; of those at or under the targets, where there are some.

    names: without contents. Local folders are listed and read by the tasks, targets
    being pushed down as filters; what has a scheme is read by Spark, which leaves
    out `.x` and `_x`.
    """
    paths = tops(paths)
    local, remote = [p for p in paths if "://" not in p], [p for p in paths if "://" in p]
    parts = []
    if local:
        # targets don't lie in one another, so the parts are disjoint; each is a read of its own, with its own filter
        under = lambda t: F.col("file").startswith(t.rstrip("/") + "/") if os.path.isdir(t) else F.col("file") == t
        parts += [_folders(spark, local, names)] if targets is None else [_folders(spark, local, names).where(under(t)) for t in tops(targets)]
    if remote:
        read = spark.read.text([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in remote], wholetext=True, recursiveFileLookup=True)
        # a path comes as a URI: %20 is a space, but + is itself
        file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
        found = read.select(file.alias("file"), F.col("value").alias("content"))
        at = lambda t: (F.col("file") == t) | F.col("file").startswith(t.rstrip("/") + "/")
        parts.append(found if targets is None else found.where(reduce(lambda a, b: a | b, map(at, targets))))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("ext", extension(F.col("file"))).select("file", "ext", "content")


def from_documents(docs: DataFrame) -> DataFrame:
    """A table of texts as files /ws/<source>/<lang>/<id>.txt."""
    file = F.concat_ws("/", F.lit("/ws"), "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    return docs.select(file.alias("file"), F.lit("txt").alias("ext"), F.coalesce("text", F.lit("")).alias("content"))


def from_pages(pages: DataFrame) -> DataFrame:
    """A table of web pages as files /ws/pages/<id>.html."""
    file = F.concat(F.lit("/ws/pages/"), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".html"))
    return pages.select(file.alias("file"), F.lit("html").alias("ext"), F.coalesce("html", F.lit("")).alias("content"))


def union(*parts: DataFrame) -> DataFrame:
    """The files of several paths, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["file"])


def targeted(files: DataFrame, targets: DataFrame | None) -> DataFrame:
    """files with is_target: those at or under a target (column `path`); without targets, all."""
    if targets is None:
        return files.withColumn("is_target", F.lit(True))
    # every folder above a file is an equi-join key, so no path is compared with every target
    ups = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n), "/")), lambda p: p != "")
    hit = files.select("file", F.explode(ups).alias("path")).join(targets.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct(), "path", "left_semi").select("file").distinct()
    return files.join(hit.withColumn("is_target", F.lit(True)), "file", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def stray_targets(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets outside the workspace: those that no file lies at or under."""
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda n: F.array_join(F.slice(F.split("file", "/"), 1, n), "/"))
    return targets.withColumn("__p", F.regexp_replace("path", "/+$", "")).join(files.select(F.explode(ups).alias("__p")).distinct(), "__p", "left_anti").drop("__p")
