"""Connected components of an undirected graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): joins each node's neighbours to the least of them; least values are pre-aggregated."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = near.where("v > u") if large else near
    out = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge and the least node it can reach. Loops and repeated edges do no harm,
    edges with a null end are ignored, an empty graph has no row. Rounds grow with the log of the nodes; each is
    written to the shared folder."""
    scratch = Scratch(edges.sparkSession)
    told = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = told.where("u = v").select(F.col("u").alias("node")).distinct()
    at, old, seen = scratch.cut(told.where("u <> v").distinct(), "e0"), "e0", None
    for k in range(1, 100):
        new = f"e{k}"
        at = scratch.cut(_stars(_stars(at, True), False), new)
        scratch.drop(old)
        old = new
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components didn't settle within 99 rounds")
    roots = at.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
