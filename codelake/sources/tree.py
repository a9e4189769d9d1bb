"""Source trees as a data source: folders are walked in parallel, and those that hold no sources are never listed.

`spark.read.format("source_tree")` walks one or more roots: the driver lists only the upper levels, until there are
enough folders to share out, and tasks walk the rest. Folders of build output, of version control and of packages are
pruned before they are opened, which a recursive listing that filters afterwards cannot do. Roots inside other roots are
walked once; links to folders are not followed. `spark.readStream` gives files as they appear, and again whenever they
change, by the time at which the file system last touched them. The folders must be mounted on all executors; what only
Spark can read is read by `files.read_files`.
"""

from __future__ import annotations

import fnmatch
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from codelake.functions.patterns import SKIPPED_FOLDERS

NAME = "source_tree"
SCHEMA = "root string, path string, changed long, text string"
GLOBS = "*.java,*.xml,*.gradle,*.kts,*.kt"
FOLDERS, FILES = 64, 500
#: Files touched within this time wait for the next look, so that none of the same moment is missed.
SETTLE_NS = 50_000_000


class Folders(InputPartition):
    """Folders to walk, or (deep=False) whose own files only are meant."""

    def __init__(self, folders: list[tuple[str, str, bool]]):
        self.folders = folders


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


def outermost(roots: list[str]) -> list[str]:
    """Real paths, without those inside others."""
    out: list[str] = []
    for r in sorted({os.path.realpath(r) for r in roots}):
        if not out or not (r + os.sep).startswith(out[-1].rstrip(os.sep) + os.sep):
            out.append(r)
    return out


def listed(folder: str, globs: list[str]) -> tuple[list[str], list[str]]:
    """(folders to go on with, files that are meant) of one folder, in order; a folder that cannot be read is empty."""
    folders, files = [], []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIPPED_FOLDERS:
                        folders.append(e.path)
                elif any(fnmatch.fnmatchcase(e.name, g) for g in globs) and e.is_file():
                    files.append(e.path)
    except OSError:
        return [], []
    return sorted(folders), sorted(files)


def walked(folder: str, globs: list[str]) -> Iterator[str]:
    todo = [folder]
    while todo:
        folders, files = listed(todo.pop(), globs)
        yield from files
        todo += reversed(folders)


def row(root: str, file: str) -> tuple | None:
    """A file's row; one that has gone meanwhile is none."""
    try:
        changed = os.stat(file).st_ctime_ns
        with open(file, "rb") as f:
            text = f.read().decode("utf-8", "replace")
    except OSError:
        return None
    return root, os.path.relpath(file, root).replace(os.sep, "/"), changed, text.removeprefix("﻿")


class Tree:
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("source_tree needs a path, or several with ':' between them")
        self.roots = outermost(options["path"].split(os.pathsep))
        self.globs = options.get("globs", GLOBS).split(",")


class TreeReader(Tree, DataSourceReader):
    def partitions(self) -> list[Folders]:
        todo, own = [(r, r) for r in self.roots], []
        while todo and len(todo) < FOLDERS:
            below = [(root, f) for root, folder in todo for f in listed(folder, self.globs)[0]]
            own += [(root, folder, False) for root, folder in todo]
            todo = below
        return [Folders([f]) for f in [*own, *[(root, folder, True) for root, folder in todo]]] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for root, folder, deep in partition.folders:
            for file in walked(folder, self.globs) if deep else listed(folder, self.globs)[1]:
                if r := row(root, file):
                    yield r


class TreeStream(Tree, DataSourceStreamReader):
    """Offsets are points in time; a step holds the files that were touched after one and up to the next."""

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - SETTLE_NS}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        found = []
        for root in self.roots:
            for file in walked(root, self.globs):
                try:
                    changed = os.stat(file).st_ctime_ns
                except OSError:
                    continue
                if start["ns"] < changed <= end["ns"]:
                    found.append((root, file, changed))
        return [Files(found[i : i + FILES]) for i in range(0, len(found), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for root, file, _ in partition.files:
            if r := row(root, file):
                yield r

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """Options: path (one root, or several with the system's path separator between them), globs (with commas between them)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)
