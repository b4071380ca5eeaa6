"""Source trees as tables: a lister on the driver that prunes folders, a distributed read."""

from __future__ import annotations

import os
from collections.abc import Iterable
from pathlib import Path, PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import decoded


def matches(globs: Iterable[str], path: PurePath) -> bool:
    """Whether a glob takes the path. Leading dots and slashes of a glob don't count, nor does a ``**/`` it begins with. What
    stands before the first ``/**`` is a folder, of one name or more, that takes all below it wherever it lies; a folder
    with wildcards before a last ``/**`` takes paths that match it."""
    said = path.as_posix()
    for glob in globs:
        glob = glob.lstrip("./")
        folder, deep, _ = glob.partition("/**")
        if any(path.match(g) for g in (glob, glob.removeprefix("**/"), glob.removesuffix("/**")) if g):
            return True
        if deep and (folder := folder.removeprefix("**/")) and (said == folder or f"/{folder}/" in f"/{said}"):
            return True
    return False


def listed(paths: Iterable[str], include: Iterable[str], exclude: Iterable[str]) -> list[str]:
    """Files under the paths, each once, in order; missing paths are passed over, excluded folders never entered."""
    include, exclude, out = list(include), list(exclude), {}
    for given in paths:
        top = Path(given)
        if top.is_file():
            shown = Path(os.path.relpath(top)) if top.is_absolute() and top.is_relative_to(Path.cwd()) else top
            if matches(include, shown) and not matches(exclude, shown):
                out.setdefault(os.path.realpath(top), str(top))
        for folder, inner, names in os.walk(top) if top.is_dir() else ():
            rel = Path(folder).relative_to(top)
            inner[:] = sorted(d for d in inner if not matches(exclude, rel / d / "x"))
            for name in sorted(names):
                if matches(include, rel / name) and not matches(exclude, rel / name):
                    out.setdefault(os.path.realpath(os.path.join(folder, name)), os.path.join(folder, name))
    return list(out.values())


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content, content_hash, language of the listed files; those that can't be read are left out."""
    schema = "path string, content string, content_hash string, language string"
    readable = [p for p in paths if os.access(p, os.R_OK)]
    if not readable:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load(["file://" + os.path.abspath(p) for p in readable])
    shown = {os.path.abspath(p): p for p in readable}
    names = spark.createDataFrame(list(shown.items()), "at string, path string")
    text = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("at"), decoded(F.col("content")).alias("content"))
    return text.join(names, "at").select("path", "content", F.sha2("content", 256).alias("content_hash"), F.when(F.col("path").rlike(r"[^/]\.py$"), "python").otherwise("text").alias("language"))


#: a row group is read by one task, so a table with less than this for each core is dealt out
ROW_GROUP_BYTES = 128 << 20


def dealt(df: DataFrame) -> DataFrame:
    """``df`` spread over all cores if it is too small for its row groups to do so; larger tables stay as they are read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * ROW_GROUP_BYTES else df


def table_files(df: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    """Rows of a table as text files."""
    content = F.replace(F.replace(F.coalesce(text_col, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.select(F.concat(F.lit(prefix), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("path"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.lit("text").alias("language"))
