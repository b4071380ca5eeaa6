"""Source trees as a data source: folders are listed by tasks, files read by other tasks, which are dealt them by size.

The driver looks at the given paths and at as many levels below as it takes to have folders enough for the tasks, so it holds
folders, never files. A folder that is excluded is never opened, nor is one that a filter on ``path`` rules out. On a cluster the tree lies
in a folder that all executors have mounted.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from ..functions.columns import decoded
from .files import matches

LISTED = "nth int, path string, at string, real string, size long"


@dataclass
class Folder(InputPartition):
    """A folder, or a file, of the ``nth`` given path: where it is, how it is shown, what of it lies below the given path, and whether the
    folders in it are partitions of their own."""

    nth: int
    at: str
    shown: str
    below: str
    flat: bool


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def _inner(f: Folder, exclude: list[str]) -> list[Folder]:
    """The folders in a folder, but for excluded ones."""
    told = [Folder(f.nth, e.path, os.path.join(f.shown, e.name), os.path.join(f.below, e.name), False) for e in _entries(f.at) if e.is_dir(follow_symlinks=False)]
    return [d for d in told if not matches(exclude, PurePath(d.below) / "x")]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.include, self.exclude = (json.loads(options.get(k, "[]")) for k in ("paths", "include", "exclude"))
        self.here, self.least, self.begins = options.get("here", os.getcwd()), int(options.get("folders", 64)), []

    def possible(self, shown: str) -> bool:
        """Whether a folder may hold a path that the filters take."""
        inside = os.path.join(shown, "")
        return all(inside.startswith(b) or b.startswith(inside) for b in self.begins)

    def partitions(self) -> list[Folder]:
        done, todo = [], []
        for nth, given in enumerate(self.paths):
            at = os.path.join(self.here, given)
            if os.path.isfile(at):
                done.append(Folder(nth, at, given, "", True))
            elif os.path.isdir(at) and self.possible(given):
                todo.append(Folder(nth, at, given, "", False))
        while todo and len(todo) < self.least:  # a level more
            deeper = [d for f in todo for d in _inner(f, self.exclude) if self.possible(d.shown)]
            done += [Folder(f.nth, f.at, f.shown, f.below, True) for f in todo]
            todo = deeper
        return done + todo

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:  # what Spark gives where there is no partition
            return
        takes = lambda path: matches(self.include, path) and not matches(self.exclude, path)
        row = lambda at, shown: (partition.nth, shown, at, os.path.realpath(at), os.path.getsize(at))
        if os.path.isfile(partition.at):
            top = Path(partition.shown)
            shown = Path(os.path.relpath(top, self.here)) if top.is_absolute() and top.is_relative_to(self.here) else top
            if takes(shown):
                yield row(partition.at, partition.shown)
            return
        todo = [partition]
        while todo:
            f = todo.pop()
            for e in _entries(f.at):
                if not e.is_dir() and takes(PurePath(f.below) / e.name) and os.access(e.path, os.R_OK):
                    yield row(e.path, os.path.join(f.shown, e.name))
            if not f.flat:
                todo += [d for d in _inner(f, self.exclude) if self.possible(d.shown)]


class FilteredReader(TreeReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; in others Spark takes no reader that has this method."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the beginning of ``path`` rule out folders; Spark asks all of them of the rows as well."""
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",):
                self.begins.append(f.value)
            yield f


class Tree(DataSource):
    """``source_tree``: nth, path, at, real, size of the files below ``paths``, by ``include`` and ``exclude`` globs (each a JSON array)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> TreeReader:  # noqa: ARG002
        return (FilteredReader if self.options.get("pushed") == "true" else TreeReader)(self.options)


def listed_files(spark: SparkSession, paths: list[str], include: list[str], exclude: list[str]) -> DataFrame:
    """nth, path, at, real, size: each file once, by the first given path and the least name that lead to it; missing paths are
    passed over."""
    spark.dataSource.register(Tree)
    said = {"paths": json.dumps([str(p) for p in paths]), "include": json.dumps(list(include)), "exclude": json.dumps(list(exclude)), "here": os.getcwd(), "folders": str(2 * spark.sparkContext.defaultParallelism)}
    said["pushed"] = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    found = spark.read.format("source_tree").options(**said).load()
    return found.groupBy("real").agg(F.min(F.struct("nth", "path", "at", "size")).alias("f")).select("f.*", "real")


#: bytes of files that a task reads together
TOGETHER = 32 << 20


def read_tree(spark: SparkSession, paths: list[str], include: list[str], exclude: list[str]) -> DataFrame:
    """path, content, content_hash, language of the files below the paths; those that can't be read are left out."""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
            names, data = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["path", "content"])

        held, size = [], 0
        for b in batches:
            for path, at in zip(b["path"].to_pylist(), b["at"].to_pylist(), strict=True):
                try:
                    held.append((path, Path(at).read_bytes()))
                except OSError:
                    continue
                size += len(held[-1][1])
                if size >= TOGETHER:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    dealt = listed_files(spark, paths, include, exclude).select("path", "at", "size").repartition(2 * spark.sparkContext.defaultParallelism, "path")
    text = dealt.select("path", "at").mapInArrow(contents, "path string, content binary").select("path", decoded(F.col("content")).alias("content"))
    return text.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.when(F.col("path").rlike(r"[^/]\.py$"), "python").otherwise("text").alias("language"))
