"""Connected components that are kept: edges come and go, and only components that a lost edge touches are worked out anew.

A version of the state has the edges and each node's component, as rows that take the place of older ones of their key; an update
writes those that it changes, a lost one as a row that says so. Components that lose no edge count as one node each, their least one,
so an edge that comes is an edge between two such nodes however large they are; those that lose one bring all the edges they have left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .snapshots import Store

EDGES = "edge struct<src:string,dst:string>, alive boolean"
NODES = "node string, component string"


class Clusters:
    """Components of a graph of strings, in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Store(spark, folder)

    def labels(self) -> DataFrame:
        """node, component (its least node) of every node with an edge."""
        return self.store.latest("nodes", NODES, "node").where("component is not null")

    def edges(self) -> DataFrame:
        return self.store.latest("edges", EDGES, "edge").where("alive").select("edge.*")

    def update(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Labels after edges (src, dst) are added and removed; what is in both is there afterwards. Edges have no direction, those with a
        null end are passed over, as are removed ones that aren't there."""
        scratch = Scratch(self.spark)
        told = lambda d: d.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        here, labels = self.edges(), scratch.cut(self.labels(), "labels")
        new = scratch.cut(told(added).join(here, ["src", "dst"], "left_anti"), "new")
        gone = scratch.cut(told(removed).join(told(added), ["src", "dst"], "left_anti").join(here, ["src", "dst"], "left_semi"), "gone")
        if new.isEmpty() and gone.isEmpty():
            return self.labels()
        # components with a lost edge are taken apart: both ends of an edge are in one, so its source tells which
        apart = scratch.cut(gone.select(F.col("src").alias("node")).join(labels, "node").select("component").distinct(), "apart")
        loose = scratch.cut(labels.join(apart, "component", "left_semi").select("node"), "loose")
        left = here.join(loose, here["src"] == loose["node"], "left_semi").join(gone, ["src", "dst"], "left_anti")
        # an end that lies in a component which stays whole stands for it
        kept = labels.join(apart, "component", "left_anti").select("node", "component")
        end = lambda d, c: d.join(kept.toDF(f"{c}_node", f"{c}_in"), F.col(c) == F.col(f"{c}_node"), "left").withColumn(c, F.coalesce(f"{c}_in", c)).drop(f"{c}_node", f"{c}_in")
        found = scratch.cut(connected_components(left.unionByName(end(end(new, "src"), "dst"))), "found")
        # nodes of components that stay whole take their component's new name if it has one; others have their own, or no edge any more
        renamed = found.where("node <> component").toDF("old", "component")
        moved = kept.withColumnRenamed("component", "old").join(renamed, "old").select("node", "component")
        fresh = found.join(kept.select("node"), "node", "left_anti").select("node", "component")
        lone = loose.join(found, "node", "left_anti").select("node", F.lit(None).cast("string").alias("component"))
        changed = scratch.cut(moved.unionByName(fresh).unionByName(lone), "changed")
        as_edges = lambda d, alive: d.select(F.struct("src", "dst").alias("edge"), F.lit(alive).alias("alive"))
        edges = self.store.part(as_edges(new, True).unionByName(as_edges(gone, False)))
        nodes = self.store.part(changed)
        self.store.update(lambda base: {name: [*base.tables.get(name, []), part] for name, part in (("edges", edges), ("nodes", nodes))})
        if len(self.store.current().tables["nodes"]) >= self.store.most:
            self.store.compact("edges", EDGES, "edge")
            self.store.compact("nodes", NODES, "node")
        return self.labels()

    def sync(self, edges: DataFrame) -> DataFrame:
        """Labels after the graph has become just these edges (src, dst)."""
        here = self.edges()
        told = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return self.update(edges, here.join(told, ["src", "dst"], "left_anti"))
