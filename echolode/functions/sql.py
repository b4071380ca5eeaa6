"""What this package can do, as functions of SQL: table functions for LATERAL, and scalar ones.

    register(spark)
    spark.sql("SELECT path, f.* FROM files, LATERAL source_functions(content) f")

Table functions run in Python over Arrow batches, a call's rows for each row of the table beside it; scalar ones but ``normalised`` are SQL
expressions, so nothing leaves the JVM for them. A null text has no rows and no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import calls, syntax


@udtf(returnType="ord int, qualified_name string, start_line int, end_line int, code string", useArrow=True)
class SourceFunctions:
    """The functions of a Python source, in order; none if it doesn't parse."""

    def eval(self, source: str) -> Iterator[tuple]:
        for k, found in enumerate(syntax.functions(source or "")):
            yield k, *found


@udtf(returnType="at int, rel int, raw string", useArrow=True)
class LineWindows:
    """Sliding windows of a text's lines: line before the first, last line, text; those with at least ``least`` lines that aren't blank."""

    def eval(self, text: str, size: int, stride: int, least: int) -> Iterator[tuple]:
        if size <= 0 or stride <= 0:
            raise ValueError("window and stride must be positive")
        yield from syntax.windows(text or "", size, stride, least)


@udtf(returnType="place int, form string, base string, name string", useArrow=True)
class SourceCalls:
    """What a function's code calls, each once, in order: ``f()`` (name), ``x.f()`` (attr), ``C().f()`` (ctor)."""

    def eval(self, code: str) -> Iterator[tuple]:
        for k, found in enumerate(calls.facts(code or "")[0]):
            yield k, *found


TABLES = {"source_functions": SourceFunctions, "line_windows": LineWindows, "source_calls": SourceCalls}

# as columns.tokens and columns.jaccard have them
SCALARS = {
    "tokens": ("text STRING", "ARRAY<STRING>", r"array_sort(array_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+', 0)))"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / (size(a) + size(b) - size(array_intersect(a, b))) END"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session; once more does no harm."""
    for name, made in TABLES.items():
        spark.udtf.register(name, made)
    for name, (takes, gives, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.udf.register("normalised", lambda text: syntax.normalised(text or ""), "string")
