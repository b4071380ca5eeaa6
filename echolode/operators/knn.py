"""Nearest neighbours by cosine, exact: in blocks of the index, and by k-means cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: bytes of a block of vectors; a task holds two and the best of one
BLOCK_BYTES = 16 << 20
#: rows and columns of a tile of scores, which stays in a core's cache
TILE = (256, 4096)
#: decimals of a score: float noise does not decide between ties, which go to the lower position
DECIMALS = 9


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("a_pos").orderBy(F.desc("score"), "b_pos"))).where(F.col("rank") <= k)


class Search:
    """The k best so far of a block's vectors, by score, then position. Products are made in tiles of single precision and held
    against each row's k-th best less the error they may have; what is left is scored in double precision."""

    def __init__(self, at: np.ndarray, a: np.ndarray, k: int, least: float | None) -> None:
        self.at, self.a, self.k, self.low = at, a, k, a.astype(np.float32)
        self.error = (a.shape[1] + 8) * 6e-8 + 1e-8
        self.least, self.fresh = -np.inf if least is None else least - 1e-6, True
        self.score, self.pos = np.full((len(at), k), -np.inf), np.zeros((len(at), k), np.int64)

    def look(self, b_at: np.ndarray, b: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Hold the block's vectors, or those numbered ``asking``, against others."""
        asking, low = np.arange(len(self.at)) if asking is None else asking, b.astype(np.float32)
        for start in range(0, len(asking), TILE[0]):
            rows = asking[start : start + TILE[0]]
            mine, held, i, j = self.low[rows], 0, [], []
            floor = self.floor(rows)
            for at in range(0, len(b), TILE[1]):
                s = mine @ low[at : at + TILE[1]].T
                if at == 0 and s.shape[1] > self.k and (self.fresh or np.isneginf(self.least)) and np.isneginf(self.score[rows, -1]).any():
                    # the k best of this tile alone are a bound for all that follows
                    floor = np.maximum(floor, np.partition(s, -self.k, axis=1)[:, -self.k] - np.float32(2 * self.error))
                x, y = np.divmod(np.flatnonzero(s >= floor[:, None]), s.shape[1])
                i, j, held = [*i, x], [*j, y + at], held + len(x)
                if held > 4 * TILE[0] * self.k:
                    floor = self.merge(rows, np.concatenate(i), np.concatenate(j), b_at, b)
                    held, i, j = 0, [], []
            if held:
                self.merge(rows, np.concatenate(i), np.concatenate(j), b_at, b)
        self.fresh = False

    def floor(self, rows: np.ndarray) -> np.ndarray:
        return (np.maximum(self.score[rows, -1], self.least) - self.error).astype(np.float32)

    def merge(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray, b_at: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.round(np.einsum("ij,ij->i", self.a[rows[i]], b[j]), DECIMALS)
        good = s >= self.least
        have_i, have_k = np.nonzero(self.score[rows] > -np.inf)
        i, s, pos = np.concatenate([i[good], have_i]), np.concatenate([s[good], self.score[rows[have_i], have_k]]), np.concatenate([b_at[j[good]], self.pos[rows[have_i], have_k]])
        order = np.lexsort((pos, -s, i))
        i, s, pos = i[order], s[order], pos[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, s, pos, nth = (x[nth < self.k] for x in (i, s, pos, nth))
        self.score[rows[i], nth], self.pos[rows[i], nth] = s, pos
        return self.floor(rows)

    def found(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.at), 4096):
            score, pos, at = (x[start : start + 4096] for x in (self.score, self.pos, self.at))
            i, n = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(at[i]), pa.array(pos[i, n]), pa.array(score[i, n])], names=["a_pos", "b_pos", "score"])


def _distinct(scratch: Scratch, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pos, data), unit vectors as bytes, and (data, rep), the distinct ones. Null and empty vectors take no part; one with a
    component that is null or not finite is an error that names its position."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = b["vec"].value_lengths().to_numpy(zero_copy_only=False), b["vec"].flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(set(sizes)) == 1:
                rows = _unit(flat.reshape(b.num_rows, -1)) + 0.0  # no negative zeros
            else:
                rows = [_unit(x[None])[0] + 0.0 for x in np.split(flat, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([b["pos"], pa.array([x.tobytes() for x in rows], pa.binary())], names=["pos", "data"])

    known = vectors.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).select("pos", F.col("vec").cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = known.withColumn("vec", F.when(odd, F.raise_error(F.concat(F.lit("the vector at position "), F.col("pos").cast("string"), F.lit(" has a component that is null or not finite")))).otherwise(F.col("vec")))
    told = scratch.cut(known.mapInArrow(units, "pos long, data binary"), "told")
    return told, scratch.cut(told.groupBy("data").agg(F.min("pos").alias("rep")), "reps")


def _sized(reps: DataFrame) -> tuple[int, int]:
    """Number of distinct vectors, and the bytes of one; vectors of several lengths are an error that names one of them."""
    size = F.octet_length("data")
    n, least, most, at = reps.agg(F.count("*"), F.min(size), F.max(size), F.min_by("rep", size)).first()
    if n and least != most:
        raise ValueError(f"vectors must be of one length: that at position {at} has {least // 8} components, others {most // 8}")
    return n, most


def _packed(numbered: DataFrame, floors: bool = False) -> DataFrame:
    """A row for each block of (block, rep, data): its number, positions and vectors as bytes, one after the other; with ``floors``
    the numbers of a column floor too."""

    def row(block: int, at: list[int], data: list[bytes], floor: list[float]) -> pa.RecordBatch:
        told = [pa.array([block], pa.int32()), pa.array([np.array(at, np.int64).tobytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())]
        return pa.RecordBatch.from_arrays([*told, *([pa.array([np.array(floor, float).tobytes()], pa.binary())] if floors else [])], names=["block", "at", "data", *(["floor"] if floors else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, data, floor = None, [], [], []
        for b in batches:
            for block, rep, x, low in zip(*(b[c].to_pylist() for c in ("block", "rep", "data")), b["floor"].to_pylist() if floors else [0.0] * b.num_rows, strict=True):
                if block != now and at:
                    yield row(now, at, data, floor)
                    at, data, floor = [], [], []
                now = block
                at.append(rep)
                data.append(x)
                floor.append(low)
        if at:
            yield row(now, at, data, floor)

    cols = ["block", "rep", "data", *(["floor"] if floors else [])]
    return numbered.repartition("block").sortWithinPartitions("block", "rep").select(*cols).mapInArrow(run, "block int, at binary, data binary" + (", floor binary" if floors else ""))


def _searched(scratch: Scratch, told: DataFrame, numbered: DataFrame, many: int, k: int, least: float | None, cells: tuple[list[int], np.ndarray, np.ndarray, int] | None = None) -> DataFrame:
    """The k best for each row of ``told``, by distinct vectors (rep, data, block). A block is held against all ``many``, its own
    first, and only its k best leave the task. ``cells``: of each block its cell; centers and widest angles of cells, and the
    number of nearest blocks that are searched before the bound on angles is asked."""

    blocks = scratch.cut(_packed(numbered), "blocks")
    if cells:
        of, centers, wide, probes = cells
        order = np.arccos(np.clip(centers[of] @ centers[of].T, -1, 1)) + 10.0 * (1 - np.eye(many))
        place = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1)
        ranks = told.sparkSession.createDataFrame(pa.table({"a": np.repeat(np.arange(many, dtype=np.int32), many), "block": np.tile(np.arange(many, dtype=np.int32), many), "place": place.ravel().astype(np.int32)}))
        pairs = blocks.join(F.broadcast(ranks), "block").select("a", "place", "block", "at", "data")
    else:
        pairs = blocks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).select("a", (F.col("block") != F.col("a")).cast("int").alias("place"), "block", "at", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search, angles = None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                a, place, block = (batch[c][r].as_py() for c in ("a", "place", "block"))
                at = np.frombuffer(batch["at"][r].as_buffer(), np.int64)
                data = np.frombuffer(batch["data"][r].as_buffer(), float).reshape(len(at), -1)
                if a != now and search:
                    yield from search.found()
                if a != now:
                    now, search = (a, Search(at.copy(), data.copy(), k, least)) if a == block else (a, None)
                    angles = np.arccos(np.clip(data @ centers.T, -1, 1)) if cells and search else None
                if not search:  # a block without rows asks nothing
                    continue
                asking = None
                if cells and place >= probes:
                    asking = np.flatnonzero(np.cos(np.maximum(0, angles[:, of[block]] - wide[of[block]])) >= search.score[:, -1] - 1e-6)
                search.look(at, data, asking)
        if search:
            yield from search.found()

    best = pairs.repartitionById(many, F.col("a")).sortWithinPartitions("a", "place", "block").mapInArrow(run, "a_pos long, b_pos long, score double").toDF("a_rep", "b_rep", "score")
    # back to rows: the first k positions of a neighbour's class are enough
    members = told.join(numbered.select("data", "rep"), "data").select("rep", "pos")
    first = members.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("pos"))).where(F.col("nth") <= k)
    few = _best(best.join(first.select(F.col("rep").alias("b_rep"), F.col("pos").alias("b_pos")), "b_rep").select(F.col("a_rep").alias("a_pos"), "b_pos", "score"), k)
    return few.withColumnRenamed("a_pos", "a_rep").join(members.toDF("a_rep", "a_pos"), "a_rep").select("a_pos", "b_pos", "score", "rank")


def knn(vectors: DataFrame, k: int, least: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a_pos, b_pos, score, rank: the ``k`` best of all rows for each row (itself one of them), by (pos, vec array).

    Pairs below ``least`` may be left out. Equal vectors are searched for once, and are found once: the search is
    among distinct vectors, and of the positions of each the first k can be among the best. They are cut into blocks of
    bounded size, written to the shared folder; a task holds one block's vectors and their k best, and all blocks pass
    through it, so nothing passes through the driver. Null and empty vectors take no part; a component that is null or not
    finite, or vectors of several lengths, are errors that name a position."""
    spark = vectors.sparkSession
    empty = "a_pos long, b_pos long, score double, rank int"
    if k <= 0:
        return spark.createDataFrame([], empty)
    scratch = Scratch(spark)
    told, reps = _distinct(scratch, vectors)
    n, width = _sized(reps)
    if not n:
        return spark.createDataFrame([], empty)
    many = max(-(-n * width // block_bytes), min(2 * spark.sparkContext.defaultParallelism, n))
    return _searched(scratch, told, reps.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(many)).cast("int")), many, k, least)


def ask(vectors: DataFrame, k: int, least: float | None = None, block_bytes: int = BLOCK_BYTES, distinct: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """A search in which few rows ask, by (pos, vec, asks, floor): the ``k`` best of all rows for each row that asks (a_pos, b_pos, score,
    rank), and for every other one the asking rows whose score is at least its ``floor`` (a_pos, b_pos, score; null: no floor), of each
    distinct vector the first k.

    Rows whose vector is an asking row's are answered as asking ones, whether they ask or not. Blocks of asking vectors pass
    over all blocks, so what is shuffled and worked out is asking times all; each block's work is dealt out in slices."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    told, _ = distinct or _distinct(scratch, vectors)
    flags = vectors.select("pos", F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("floor"))
    reps = scratch.cut(told.join(flags, "pos").groupBy("data").agg(F.min("pos").alias("rep"), F.max("asks").alias("asks"), F.min("floor").alias("floor")), "asked")
    n, width = _sized(reps)
    asking = reps.where("asks").count()
    found, beaten = "a_pos long, b_pos long, score double, rank int", "a_pos long, b_pos long, score double"
    if not asking or k <= 0:
        return spark.createDataFrame([], found), spark.createDataFrame([], beaten)
    cores = spark.sparkContext.defaultParallelism
    count = lambda rows: max(-(-rows * width // block_bytes), min(cores, rows))
    own, many = -(-asking * width // block_bytes), count(n - asking)  # blocks that ask, and others after them
    slices = max(1, min(-(-2 * cores // own), own + many))
    numbered = reps.withColumn("block", F.when(F.col("asks"), F.pmod(F.xxhash64("rep"), F.lit(own))).otherwise(own + F.pmod(F.xxhash64("rep"), F.lit(max(many, 1)))).cast("int"))
    blocks = scratch.cut(_packed(numbered, floors=True), "blocks")
    # every block goes to its slice of every asking block; an asking block goes to each slice of its own first
    theirs = blocks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(own - 1)))).select("a", (F.col("block") % slices).alias("slice"), F.lit(1).alias("place"), "block", "at", "data", "floor")
    ours = blocks.where(F.col("block") < own).select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("place"), "block", "at", "data", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        as_rows = lambda a, b, s, kind: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array(np.full(len(a), kind), pa.bool_())], names=["a", "b", "score", "beats"])
        whole = lambda search: (as_rows(b["a_pos"], b["b_pos"], b["score"], False) for b in search.found())
        for batch in batches:
            for r in range(batch.num_rows):
                at = np.frombuffer(batch["at"][r].as_buffer(), np.int64)
                data = np.frombuffer(batch["data"][r].as_buffer(), float).reshape(len(at), -1)
                if batch["place"][r].as_py() == 0:
                    if search:
                        yield from whole(search)
                    search = Search(at.copy(), data.copy(), k, least)
                    continue
                search.look(at, data)
                if batch["block"][r].as_py() >= own:
                    floor = np.frombuffer(batch["floor"][r].as_buffer(), float)
                    if np.isposinf(floor).all():
                        continue
                    for start in range(0, len(search.at), TILE[0]):
                        mine = slice(start, start + TILE[0])
                        low = search.low[mine] @ data.astype(np.float32).T
                        i, j = np.nonzero(low >= np.maximum(floor, search.least)[None] - search.error)
                        s = np.round(np.einsum("ij,ij->i", search.a[mine][i], data[j]), DECIMALS)
                        good = s >= np.maximum(floor[j], search.least)
                        yield as_rows(at[j[good]], search.at[mine][i[good]], s[good], True)
        if search:
            yield from whole(search)

    both = ours.unionByName(theirs).repartition("a", "slice").sortWithinPartitions("a", "slice", "place", "block").mapInArrow(run, "a long, b long, score double, beats boolean")
    both = scratch.cut(both, "answers")
    members = told.join(reps.select("data", "rep", "asks"), "data").select("rep", "pos", "asks")
    nth = F.row_number().over(W.partitionBy("rep").orderBy("pos"))
    first = members.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("rep").alias("b"), F.col("pos").alias("b_pos"))
    best = _best(both.where("not beats").join(first, "b").select(F.col("a").alias("a_pos"), "b_pos", "score"), k)
    best = best.withColumnRenamed("a_pos", "a").join(members.where("asks").select(F.col("rep").alias("a"), F.col("pos").alias("a_pos")), "a").select("a_pos", "b_pos", "score", "rank")
    beats = both.where("beats").join(first, "b").join(members.select(F.col("rep").alias("a"), F.col("pos").alias("a_pos")), "a").select("a_pos", "b_pos", "score")
    return best, beats


def knn_sql(vectors: DataFrame, k: int) -> DataFrame:
    """The same in plain SQL, for reading and for tests: every pair is made, so use it on small tables only."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select("pos", F.col("vec").cast("array<double>").alias("vec"))
    v = v.withColumn("norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    v = v.withColumn("norm", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))
    a, b = (v.select(*[F.col(c).alias(f"{s}_{c}") for c in v.columns]) for s in "ab")
    pairs = a.crossJoin(b).select("a_pos", "b_pos", F.round(dot(F.col("a_vec"), F.col("b_vec")) / (F.col("a_norm") * F.col("b_norm")), DECIMALS).alias("score"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("a_pos").orderBy(F.desc("score"), "b_pos"))).where(F.col("rank") <= k)


def knn_cells(vectors: DataFrame, k: int, cells: int = 128, probes: int = 8, sample: int = 50_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact by k-means cells fitted on at most about ``sample`` rows: the rows of a cell are compared with those of the
    ``probes`` cells nearest to it (itself the first), then with those of every other cell that may hold a row as near as
    their k-th best. A cell holds none for a row if the angle to its center, less its widest angle, is larger than the k-th
    best's. Where cells are wide for their distance, as with vectors without clusters, that is nearly all cells. A cell is
    a block of the search, or more of them if it is over ``block_bytes``."""
    vectors = vectors.where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    if k <= 0:
        return knn(vectors, k)
    scratch = Scratch(vectors.sparkSession)
    told, reps = _distinct(scratch, vectors)
    n, width = _sized(reps)
    known = vectors.where(F.exists("vec", lambda x: x != 0)).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))  # zero vectors have no direction
    if n < cells or not known.head(1):
        return knn(vectors, k)
    model = KMeans(k=cells, seed=7, distanceMeasure="cosine", maxIter=10).fit(known.sample(min(1.0, sample / vectors.count()), seed=7))
    centers = _unit(np.array([np.asarray(c) for c in model.clusterCenters()]))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = np.arccos(np.clip(np.frombuffer(b"".join(b["data"].to_pylist()), float).reshape(b.num_rows, -1) @ centers.T, -1, 1))
                yield pa.RecordBatch.from_arrays([b["rep"], b["data"], pa.array(angle.argmin(axis=1).astype(np.int32)), pa.array(angle.min(axis=1))], names=["rep", "data", "cell", "angle"])

    routed = scratch.cut(reps.select("rep", "data").mapInArrow(nearest, "rep long, data binary, cell int, angle double"), "routed")
    wide, of, starts, parts = np.zeros(len(centers)), [], [0] * len(centers), [1] * len(centers)
    for cell, size, angle in sorted(tuple(r) for r in routed.groupBy("cell").agg(F.count("*"), F.max("angle")).collect()):  # one row a cell
        wide[cell], starts[cell], parts[cell] = angle, len(of), -(-size * width // block_bytes)
        of += [cell] * parts[cell]
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("cell"))
    numbered = routed.select("rep", "data", (at(starts) + F.pmod(F.xxhash64("rep"), at(parts))).cast("int").alias("block"))
    return _searched(scratch, told, numbered, len(of), k, None, (of, centers, wide, probes))
