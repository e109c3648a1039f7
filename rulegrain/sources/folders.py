"""A workspace as a data source: tasks list the folders and read their files.

The driver looks at folders only until it has as many as there should be
tasks; each task walks the folders that it got. Filters on `file` (equal, one of, starts
with) go down to the listing: a folder that can't hold a wanted file is never
opened. Paths are taken literally, brackets and braces too; files and folders named
`.x` or `_x` are files like others. Contents are UTF-8; what isn't, is replaced.

Paths are local, and mounted on every executor.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

FORMAT = "rule_workspace"
SCHEMA = "file string, content string"
#: Characters of contents in a batch, about.
HELD = 8 << 20


@dataclass
class Folders(InputPartition):
    """Folders to walk, and files to read."""

    folders: tuple[str, ...] = ()
    files: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__init__(None)


def _entries(folder: str) -> tuple[list[str], list[str]]:
    """The folders and the files in a folder, by name; links to folders aren't followed."""
    folders, files = [], []
    with os.scandir(folder) as found:
        for e in sorted(found, key=lambda e: e.name):
            (folders if e.is_dir(follow_symlinks=False) else files).append(e.path)
    return folders, [f for f in files if os.path.isfile(f)]


@dataclass(frozen=True)
class Wanted:
    """What pushed filters ask of a file's name; all must hold."""

    names: tuple[frozenset[str], ...] = ()
    prefixes: tuple[str, ...] = ()

    def file(self, path: str) -> bool:
        return all(path in n for n in self.names) and all(path.startswith(p) for p in self.prefixes)

    def folder(self, path: str) -> bool:
        """Whether a wanted file can lie under the folder."""
        top = path.rstrip("/") + "/"
        return all(any(n.startswith(top) for n in ns) for ns in self.names) and all(top.startswith(p) or p.startswith(top) for p in self.prefixes)


class WorkspaceReader(DataSourceReader):
    """Options: paths (a JSON list), tasks (how many folders to look for), names (true: no contents)."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.tasks = int(options.get("tasks", "16"))
        self.names = options.get("names", "false").lower() == "true"
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names, prefixes = [], []
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                names.append(frozenset([f.value]))
            elif isinstance(f, In) and f.attribute == ("file",):
                names.append(frozenset(f.value))
            elif isinstance(f, StringStartsWith) and f.attribute == ("file",):
                prefixes.append(f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("file",)):  # a file always has a name
                yield f
        self.wanted = Wanted(tuple(names), tuple(prefixes))

    def partitions(self) -> list[InputPartition]:
        folders, files = [], []
        for p in self.paths:
            if not os.path.exists(p):
                raise FileNotFoundError(p)
            if os.path.isdir(p):
                folders += [p] if self.wanted.folder(p) else []
            elif self.wanted.file(p):
                files.append(p)
        at = 0
        while at < len(folders) and len(folders) - at < self.tasks:
            inside, here = _entries(folders[at])
            folders += [f for f in inside if self.wanted.folder(f)]
            files += [f for f in here if self.wanted.file(f)]
            at += 1
        shares = [Folders((f,)) for f in folders[at:]] + [Folders((), tuple(files[k :: self.tasks])) for k in range(min(self.tasks, len(files)))]
        return shares or [Folders()]

    def read(self, partition: Folders) -> Iterator:
        import pyarrow as pa

        def below(folder: str) -> Iterator[str]:
            inside, here = _entries(folder)
            yield from (f for f in here if self.wanted.file(f))
            for f in inside:
                if self.wanted.folder(f):
                    yield from below(f)

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string())], ["file", "content"])

        rows, size = [], 0
        for path in (*partition.files, *(f for top in partition.folders for f in below(top))):
            text = None
            if not self.names:
                with open(path, "rb") as f:
                    text = f.read().decode("utf-8", "replace")
            rows.append((path, text))
            size += len(text or "") + 200
            if size > HELD:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class WorkspaceSource(DataSource):
    """The format `rule_workspace`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(dict(self.options))
