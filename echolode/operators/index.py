"""A vector index that is kept: cells of k-means as folders of a table, so that a search reads the cells that it needs and no others.

Centers are fitted once, on a bounded sample, when the index is built; every vector lies in the cell of its nearest center, and each
part of the index says how far from its center a cell's farthest vector is. Vectors that come later are a part more. A search
takes each asking vector to its ``probes`` nearest cells; ``exact``, it goes on to every other cell that may hold a vector as near as
its k-th best by the bound on angles. The cells that any asking vector needs are a filter on the table's folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn
from .scratch import Scratch
from .snapshots import Store

VECTORS = "pos long, data binary, cell int"
CENTERS = "cell int, center array<double>"
BOUNDS = "cell int, angle double, n long"


class VectorIndex:
    """An index in a folder that all executors share. ``cells`` bounds what is sent to tasks and driver: a center and a bound each."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Store(spark, folder)

    def build(self, vectors: DataFrame, cells: int = 128, sample: int = 50_000) -> None:
        """A new version with these vectors (pos, vec) alone. Null and empty ones take no part; odd ones are errors, as in knn."""
        scratch = Scratch(self.spark)
        told, _ = knn._distinct(scratch, vectors)
        known = vectors.where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0)).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
        n = known.count()
        if n > cells:
            some = known.sample(min(1.0, sample / n), seed=7)
            centers = knn._unit(np.array([np.asarray(c) for c in KMeans(k=cells, seed=7, distanceMeasure="cosine", maxIter=10).fit(some).clusterCenters()]))
        else:  # too few for cells: one of them
            width = told.agg(F.max(F.octet_length("data"))).first()[0] or 8
            centers = np.full((1, width // 8), (width // 8) ** -0.5)
        rows = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], CENTERS)
        self._write(told, centers, {"centers": [self.store.part(rows)]}, False)

    def append(self, vectors: DataFrame) -> None:
        """A version with these vectors besides; an index without any is built anew. Vectors of another length are an error."""
        centers = self._centers()
        if self.rows().isEmpty():
            return self.build(vectors)
        told, reps = knn._distinct(Scratch(self.spark), vectors)
        n, width = knn._sized(reps)
        if n and width != 8 * centers.shape[1]:
            raise ValueError(f"vectors of the index have {centers.shape[1]} components, those to be added {width // 8}")
        self._write(told, centers, {}, True)

    def _centers(self) -> np.ndarray:
        rows = self.store.read("centers", CENTERS).orderBy("cell").collect()  # a row a cell
        if not rows:
            raise LookupError(f"there is no index in {self.store.root}")
        return np.array([r["center"] for r in rows])

    def _write(self, told: DataFrame, centers: np.ndarray, more: dict, keep: bool) -> None:
        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    angle = _angles(_matrix(b["data"]), centers)
                    yield pa.RecordBatch.from_arrays([b["pos"], b["data"], pa.array(angle.argmin(axis=1).astype(np.int32)), pa.array(angle.min(axis=1))], names=["pos", "data", "cell", "angle"])

        routed = Scratch(self.spark).cut(told.mapInArrow(nearest, "pos long, data binary, cell int, angle double"), "routed")
        # a cell's rows lie in few files, a hot one's in as many as there are tasks that have some
        vectors = self.store.part(routed.select("pos", "data", "cell").repartition("cell", F.pmod(F.xxhash64("pos"), F.lit(8))), "cell")
        bounds = self.store.part(routed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")))
        before = (lambda base, name: base.tables.get(name, [])) if keep else (lambda *_: [])
        self.store.update(lambda base: more | {"vectors": [*before(base, "vectors"), vectors], "bounds": [*before(base, "bounds"), bounds]})

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """pos, data, cell of these cells, or of all; folders of other cells are not listed in the plan's scan."""
        out = None
        for p in self.store.current().tables.get("vectors", []):
            if p["files"]:
                d = self.spark.read.schema(VECTORS).parquet(f"{self.store.root}/parts/{p['folder']}")
                d = d if cells is None else d.where(F.col("cell").isin(cells))
                out = d if out is None else out.unionByName(d)
        return self.spark.createDataFrame([], VECTORS) if out is None else out

    def search(self, asks: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """a_pos, b_pos, score, rank: the ``k`` best in the index for each asking vector (pos, vec), ties by position."""
        scratch, centers = Scratch(self.spark), self._centers()
        told, reps = knn._distinct(scratch, asks)
        wide, sizes = np.full(len(centers), -1.0), np.zeros(len(centers), int)
        for r in self.store.read("bounds", BOUNDS).groupBy("cell").agg(F.max("angle"), F.sum("n")).collect():  # a row a cell
            wide[r[0]], sizes[r[0]] = r[1], r[2]
        filled = np.flatnonzero(sizes)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(filled):
                    order = filled[np.argsort(_angles(_matrix(b["data"]), centers[filled]), axis=1, kind="stable")[:, :probes]]
                    yield _wanted(b, np.repeat(np.arange(b.num_rows), order.shape[1]), order.ravel())

        first = scratch.cut(reps.select("rep", "data").mapInArrow(near, "rep long, data binary, cell int"), "first")
        best = scratch.cut(self._scored(first, sizes, k), "best")
        if exact:
            low = best.where(F.col("rank") == k).select("rep", F.col("score").alias("low"))

            def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows and len(filled):
                        angle, kth = _angles(_matrix(b["data"]), centers[filled]), b["low"].to_numpy(zero_copy_only=False)
                        open_ = np.cos(np.maximum(0, angle - wide[filled])) >= np.where(np.isnan(kth), -np.inf, kth)[:, None] - 1e-6
                        np.put_along_axis(open_, np.argsort(angle, axis=1, kind="stable")[:, :probes], False, axis=1)  # those were searched
                        i, j = np.nonzero(open_)
                        yield _wanted(b, i, filled[j])

            rest = scratch.cut(reps.join(low, "rep", "left").select("rep", "data", F.col("low").cast("double")).mapInArrow(further, "rep long, data binary, cell int"), "rest")
            both = best.drop("rank").unionByName(self._scored(rest, sizes, k).drop("rank"))
            best = knn._best(both.withColumnRenamed("rep", "a_pos"), k).withColumnRenamed("a_pos", "rep")
        members = told.join(reps, "data").select("rep", F.col("pos").alias("a_pos"))
        return best.join(members, "rep").select("a_pos", "b_pos", "score", "rank")

    def _scored(self, wanted: DataFrame, sizes: np.ndarray, k: int) -> DataFrame:
        """rep, b_pos, score, rank of the best in the cells that each vector (rep, data) wants."""
        counts = {r["cell"]: r["count"] for r in wanted.groupBy("cell").count().collect()}  # a row a cell
        if not counts:
            return self.spark.createDataFrame([], "rep long, b_pos long, score double, rank int")
        width = wanted.agg(F.max(F.octet_length("data"))).first()[0]
        by_cell = lambda n: F.get(F.array(*[F.lit(max(1, int(-(-n(c) * width // knn.BLOCK_BYTES)))) for c in range(len(sizes))]), F.col("cell"))
        slices, groups = by_cell(lambda c: sizes[c]), by_cell(lambda c: counts.get(c, 0))
        # asking vectors of a cell are groups, its own vectors are slices: a task has one of each
        ours = wanted.withColumn("group", F.pmod(F.xxhash64("rep"), groups)).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("cell", "group", "slice", F.lit(0).alias("kind"), F.col("rep").alias("pos"), "data")
        theirs = self.rows(sorted(counts)).withColumn("slice", F.pmod(F.xxhash64("pos"), slices).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), groups.cast("long") - 1))).select("cell", "group", "slice", F.lit(1).alias("kind"), "pos", "data")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, at, data, search = None, [], [], None
            for b in batches:
                keys = list(zip(*(b[c].to_pylist() for c in ("cell", "group", "slice", "kind")), strict=True))
                edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                for s, e in zip(edges, edges[1:], strict=False):
                    if e == s:
                        continue
                    part = b.slice(s, e - s)
                    if keys[s][:3] != now:
                        if search:
                            yield from search.found()
                        now, at, data, search = keys[s][:3], [], [], None
                    if keys[s][3] == 0:
                        at.append(part["pos"].to_numpy())
                        data.append(_matrix(part["data"]))
                    elif at:
                        search = search or knn.Search(np.concatenate(at), np.concatenate(data), k, None)
                        search.look(part["pos"].to_numpy(), _matrix(part["data"]))
            if search:
                yield from search.found()

        both = ours.unionByName(theirs).repartition("cell", "group", "slice").sortWithinPartitions("cell", "group", "slice", "kind").select("cell", "group", "slice", "kind", "pos", "data")
        return knn._best(both.mapInArrow(run, "a_pos long, b_pos long, score double"), k).withColumnRenamed("a_pos", "rep")


def _matrix(data: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), float).reshape(len(data), -1)


def _angles(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centers.T, -1, 1))


def _wanted(b: pa.RecordBatch, i: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b["rep"].take(pa.array(i)), b["data"].take(pa.array(i)), pa.array(cell.astype(np.int32))], names=["rep", "data", "cell"])
