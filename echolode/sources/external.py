"""Duplications that another tool reported as JSON."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = "struct<path:string,start:string,end:string,code:string,name:string>"
ENV = "ECHOLODE_SONAR_REPORT"


def external_findings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Findings of score 1 from ``duplications[].{a,b}``; a pair without one of its sides is passed over."""
    path = path or os.environ.get(ENV)
    if not path:
        raise RuntimeError(f"{ENV} must name the report")
    raw = spark.read.schema(f"duplications array<struct<a:{SIDE},b:{SIDE}>>").json(path, multiLine=True)
    return from_pairs(raw.select(F.explode("duplications").alias("d")).select("d.a", "d.b"))


def from_pairs(pairs: DataFrame) -> DataFrame:
    """Findings of pairs (a, b). A missing start is 1, a missing end the start, a missing name the path; ranges that end
    before they begin have no lines. A side that is null or has no field at all is no side."""

    def unit(side: str) -> list[Column]:
        s = F.col(side)
        start = F.coalesce(s["start"].try_cast("int"), F.lit(1))
        end, path = F.coalesce(s["end"].try_cast("int"), start), F.coalesce(s["path"], F.lit(""))
        return [path.alias(f"path_{side}"), start.alias(f"start_{side}"), end.alias(f"end_{side}"), F.coalesce(s["name"], path).alias(f"name_{side}"), F.coalesce(s["code"], F.lit("")).alias(f"code_{side}")]

    said = lambda x: F.coalesce(*[F.col(x)[c].cast("string") for c in ("path", "start", "end", "code", "name")]).isNotNull()
    d = pairs.where(said("a") & said("b")).select(*unit("a"), *unit("b"))
    ident = lambda x: F.concat_ws(":", f"path_{x}", f"name_{x}", F.col(f"start_{x}").cast("string"), F.col(f"end_{x}").cast("string"))
    lines = F.greatest(F.lit(0), F.least(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b")) + 1)
    return d.select(ident("a").alias("fn_a"), ident("b").alias("fn_b"), "path_a", "path_b", F.lit(1.0).alias("score"), F.array(F.lit("sonarqube")).alias("reasons"), lines.alias("duplicated_lines"))
