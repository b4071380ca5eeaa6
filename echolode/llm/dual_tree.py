"""Hard negatives by dual-tree search: trees over anchors and candidates, pruned by intervals of inner products.

Vectors become integers (floor of 256 times each component), scores are their exact inner products. A tree of at most
2**DEPTH leaves, whose planes are fitted on a bounded sample, takes every row to a leaf; a leaf is cut into blocks of at
most BLOCK_BYTES, and each block has its box, center and radius over all rows it holds, so bounds are exact however the
sample fell. Anchors are taken down the same tree and put into bunches of neighbouring leaves, each a tree of its own.

A search asks, for every anchor and each of its bands of scores, for the ``k`` best candidates of the same or of another
label. First each bunch is held against the leaves that its own anchors lie in, which gives every band a score to beat. Then
bunches walk down both trees at once: a pair of nodes whose interval of products lies below all scores to beat, or
above all bands, is dropped with all its anchors and candidates. Only what is left is shuffled, and scored exactly; a block that
arrives late is held against the scores to beat of that time, group of anchors by group. The work of a bunch is dealt out in
slices of SLICE blocks, so neither a hot leaf nor a large bunch is one task.

Positives are one search with an open band, negatives a second one with a band for each positive.

Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Shorter vectors count as
followed by zeros, empty ones score 0. Equal rows (vec_id, label and vector) count once; rows of one vec_id that differ are rows each, but an
anchor's positives have other ids. Ties go to the smaller vec_id. Anchors without a positive or a negative give no row, nor does an empty
table. Components beyond a 64-bit integer are an error. Columns other than vec_id, label and embedding aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, as_batch, hashed_share


@dataclass(frozen=True)
class TreeParams:
    """``sample_bytes`` bounds the rows (as doubles) that the planes are fitted on, 2**``depth`` the leaves, ``leaf_rows`` is the size of
    leaves that is aimed at while there are fewer, ``bunch`` and ``group`` bound the anchors of a bunch and of its leaves."""

    depth: int = 10
    leaf_rows: int = 1024
    sample_bytes: int = 16 << 20
    block_bytes: int = 1 << 20
    bunch: int = 256
    group: int = 16
    slice: int = 64


OPEN = 1 << 62
ASKS = "bunch int, a long, band int, score long, id long"


# --- nodes: boxes, centers, radii, and what products of two of them can be


class Nodes:
    """Boxes and balls of ``n`` sets of vectors, as arrays."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, center: np.ndarray, radius: np.ndarray) -> None:
        self.lo, self.hi, self.center, self.radius = lo, hi, center, radius

    @staticmethod
    def of(sets: list[np.ndarray]) -> Nodes:
        centers = [x.mean(axis=0) for x in sets]
        radii = [float(np.sqrt(((x - c) ** 2).sum(axis=1).max())) for x, c in zip(sets, centers, strict=True)]
        return Nodes(np.array([x.min(axis=0) for x in sets], float), np.array([x.max(axis=0) for x in sets], float), np.array(centers), np.array(radii))

    def take(self, at) -> Nodes:
        return Nodes(self.lo[at], self.hi[at], self.center[at], self.radius[at])

    def merged(self, other: Nodes) -> Nodes:
        """Nodes that hold this one and the other of each pair."""
        center = (self.center + other.center) / 2
        reach = lambda x: np.linalg.norm(x.center - center, axis=1) + x.radius
        return Nodes(np.minimum(self.lo, other.lo), np.maximum(self.hi, other.hi), center, np.maximum(reach(self), reach(other)))

    def interval(self, other: Nodes) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of a vector of each node with one of ``other`` (one node or as many)."""
        ends = np.stack([self.lo * other.lo, self.lo * other.hi, self.hi * other.lo, self.hi * other.hi])
        mid = (self.center * other.center).sum(axis=1)
        size = lambda x: np.linalg.norm(x.center, axis=1)
        ball = self.radius * size(other) + other.radius * size(self) + self.radius * other.radius
        low, high = np.maximum(ends.min(axis=0).sum(axis=1), mid - ball), np.minimum(ends.max(axis=0).sum(axis=1), mid + ball)
        slack = 1e-9 * (np.abs(low) + np.abs(high)) + 0.5  # of rounding; products are integers
        return low - slack, high + slack


def fit_planes(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of the 2**depth - 1 inner nodes: the sample's first principal direction, at the median."""
    planes, cuts, sets = np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1), {0: x}
    for k in range(len(cuts)):
        rows = sets.pop(k)
        if len(rows) > 1:
            off = rows - rows.mean(axis=0)
            v = off[np.argmax((off**2).sum(axis=1))]
            for _ in range(12):
                v = off.T @ (off @ v)
                v = v / max(float(np.linalg.norm(v)), 1e-300)
            planes[k], cuts[k] = v, np.median(rows @ v)
        right = rows @ planes[k] > cuts[k]
        sets[2 * k + 1], sets[2 * k + 2] = rows[~right], rows[right]
    return planes, cuts


def leaf_of(x: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for _ in range((len(cuts) + 1).bit_length() - 1):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, planes[at]) > cuts[at])
    return (at - len(cuts)).astype(np.int32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors, in the narrowest type that holds every partial sum."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


# --- anchors of a bunch


class Bunch:
    """Anchors with their bands, the scores to beat of each, and the groups that are pruned at once."""

    def __init__(self, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, floor: np.ndarray, ceil: np.ndarray, beat: np.ndarray, k: int, group: int) -> None:
        self.a, self.ids, self.labels, self.x, self.floor, self.ceil, self.beat, self.k = a, ids, labels, x, floor, ceil, beat, k
        self.starts = np.arange(0, len(a), group)
        self.groups = Nodes.of(np.split(x.astype(float), self.starts[1:]))
        self.best: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(floor.shape[1])]

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, the least score that helps and the greatest one that is in a band."""
        real = self.floor <= self.ceil
        low = np.where(real, np.maximum(self.floor, self.beat), OPEN).min(axis=1)
        return np.minimum.reduceat(low, self.starts), np.maximum.reduceat(np.where(real, self.ceil, -OPEN).max(axis=1), self.starts)

    def look(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, node: Nodes, same: bool) -> None:
        low, high = self.groups.interval(node)
        least, most = self.wanted()
        asking = np.flatnonzero((high >= least) & (low <= most))
        if not len(asking):
            return
        ends = np.append(self.starts[1:], len(self.a))
        rows = np.concatenate([np.arange(self.starts[g], ends[g]) for g in asking])
        s = products(self.x[rows], x)
        fits = self.labels[rows, None] == labels
        fits = fits & (self.ids[rows, None] != ids) if same else ~fits
        for band in range(self.floor.shape[1]):
            least = np.maximum(self.floor[rows, band], self.beat[rows, band])
            t = np.where(fits & (s >= least[:, None]) & (s <= self.ceil[rows, band, None]), s, -OPEN)
            if t.shape[1] > self.k:  # ties with the k-th stay, as ids decide
                t[t < np.partition(t, -self.k, axis=1)[:, -self.k, None]] = -OPEN
            i, j = np.nonzero(t > -OPEN)
            if len(i):
                self.merge(band, rows[i], t[i, j], ids[j])

    def merge(self, band: int, i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.best[band].append((i, s, ids))
        i, s, ids = (np.concatenate(x) for x in zip(*self.best[band], strict=True))
        order = np.lexsort((ids, -s, i))
        i, s, ids = i[order], s[order], ids[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        keep = nth < self.k
        self.best[band] = [(i[keep], s[keep], ids[keep])]
        last = nth == self.k - 1
        self.beat[i[last], band] = np.maximum(self.beat[i[last], band], s[last])

    def found(self, bunch: int) -> pa.RecordBatch:
        rows = [(self.a[i], np.full(len(i), band, np.int32), s, ids) for band, told in enumerate(self.best) for i, s, ids in told]
        a, band, s, ids = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return as_batch(bunch=pa.array(np.full(len(a), bunch, np.int32)), a=pa.array(a), band=pa.array(band), score=pa.array(s), id=pa.array(ids))


def walk(bunch: Bunch, heap: list[Nodes | None]) -> dict[int, float]:
    """The leaves of the candidates' tree (a heap) that a pair of leaves of both trees is left in, with the greatest bound."""
    least, most = bunch.wanted()
    levels = [(bunch.groups, least, most)]  # the anchors' tree, leaves first: neighbours are merged two by two
    while len(levels[-1][1]) > 1:
        nodes, low, top = levels[-1]
        n = len(low) // 2 * 2
        up = nodes.take(slice(0, n, 2)).merged(nodes.take(slice(1, n, 2)))
        if n < len(low):
            up = Nodes(*(np.concatenate([getattr(up, c), getattr(nodes, c)[n:]]) for c in ("lo", "hi", "center", "radius")))
        pair = lambda x, how: np.concatenate([how(x[0:n:2], x[1:n:2]), x[n:]])  # noqa: B023, E731
        levels.append((up, pair(low, np.minimum), pair(top, np.maximum)))
    inner, found, todo = len(heap) // 2, {}, [(len(levels) - 1, 0, [0])]
    while todo:
        level, a, at = todo.pop()
        nodes, least, most = levels[level]
        at = [c for c in at if heap[c] is not None]
        if not at:
            continue
        others = Nodes(*(np.concatenate([getattr(heap[c], x) for c in at]) for x in ("lo", "hi", "center", "radius")))
        low, high = others.interval(nodes.take([a]))
        left = np.flatnonzero((high >= least[a]) & (low <= most[a]))
        if not len(left):
            continue
        deeper = [d for n in left for d in ([at[n]] if at[n] >= inner else [2 * at[n] + 1, 2 * at[n] + 2])]
        if level:
            todo += [(level - 1, child, deeper) for child in (2 * a, 2 * a + 1) if child < len(levels[level - 1][1])]
        elif any(at[n] < inner for n in left):
            todo.append((0, a, deeper))
        else:
            for n in left:
                found[at[n] - inner] = max(found.get(at[n] - inner, -np.inf), float(high[n]))
    return found


# --- the search


def known(table: DataFrame, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """id, label, vec of the rows that take part."""
    d = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    return d.where("id is not null and label is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def mine(spark: SparkSession, rows: DataFrame, anchors: Column, k_positive: int = 5, k_negative: int = 5, p: TreeParams = TreeParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, by rows (id, label, vec) and a condition for anchors."""
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    scratch = Scratch(spark)
    n, dim, peak = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x))))).first()
    if not n:
        return empty
    if (peak or 0) * 256 >= 2**63:
        raise ValueError("a component times 256 is beyond a 64-bit integer")
    dim = max(dim, 1)
    kind = np.dtype("<i2" if peak * 256 < 2**15 - 1 else "<i4" if peak * 256 < 2**31 - 1 else "<i8")
    depth = min(p.depth, max(0, (n // p.leaf_rows).bit_length()))

    def integers(vecs: pa.Array) -> np.ndarray:
        size = vecs.value_lengths().to_numpy(zero_copy_only=False)
        flat = np.floor(256 * vecs.flatten().to_numpy(zero_copy_only=False).astype(float))
        out = np.zeros((len(vecs), dim))
        out[np.arange(dim) < size[:, None]] = flat
        return out

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.zeros((0, dim)), *(integers(b["vec"]) for b in batches)])
        planes, cuts = fit_planes(x, depth)
        yield as_batch(planes=pa.array([planes.tobytes()], pa.binary()), cuts=pa.array([cuts.tobytes()], pa.binary()))

    sample = hashed_share(rows, "id", max(1, p.sample_bytes // (8 * dim)), n).select("vec")
    told = sample.repartition(1).mapInArrow(fitted, "planes binary, cuts binary").toArrow()  # one row: bounded by depth
    planes, cuts = (np.frombuffer(told[c][0].as_py() if len(told) else b"", float) for c in ("planes", "cuts"))
    shared = spark.sparkContext.broadcast((planes.reshape(-1, dim), cuts))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = integers(b["vec"])
                out = pa.table({"id": b["id"], "label": b["label"], "leaf": leaf_of(x, *shared.value), "x": pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())})
                # equal rows of a batch go here already, so that a row repeated many times doesn't fill one block
                yield from out.group_by(["id", "label", "leaf", "x"]).aggregate([]).select(["id", "label", "leaf", "x"]).combine_chunks().to_batches()

    all_rows = scratch.cut(rows.mapInArrow(routed, "id long, label long, leaf int, x binary"), "routed")
    sizes = {r["leaf"]: r["count"] for r in all_rows.groupBy("leaf").count().collect()}  # at most 2**depth rows
    per_block, starts, many = max(1, p.block_bytes // (dim * kind.itemsize)), {}, 0
    for leaf in sorted(sizes):
        starts[leaf], many = many, many + -(-sizes[leaf] // per_block)
    by_leaf = lambda d: F.get(F.array(*[F.lit(d.get(leaf, 1)) for leaf in range(1 << depth)]), F.col("leaf"))
    parts = {leaf: -(-size // per_block) for leaf, size in sizes.items()}
    dealt = all_rows.withColumn("block", (by_leaf(starts) + F.pmod(F.xxhash64("id"), by_leaf(parts))).cast("int"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: number, leaf, and pickled ids, labels, vectors and bounds."""
        now, rows = None, []

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).group_by(["id", "label", "leaf", "x"]).aggregate([])
            x = np.frombuffer(b"".join(t["x"].to_pylist()), kind).reshape(len(t), dim)
            node = Nodes.of([x.astype(float)])
            data = pickle.dumps((t["id"].to_numpy(), t["label"].to_numpy(), x, node))
            return as_batch(block=pa.array([now], pa.int32()), leaf=t["leaf"].combine_chunks().slice(0, 1), data=pa.array([data], pa.binary()), node=pa.array([pickle.dumps(node)], pa.binary()))

        for b in batches:
            numbers = b["block"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)] if len(numbers) else []
            for s, e in zip(edges, edges[1:], strict=False):
                if numbers[s] != now and rows:
                    yield row()
                    rows.clear()
                now = int(numbers[s])
                rows.append(b.slice(s, e - s))
        if rows:
            yield row()

    blocks = scratch.cut(dealt.repartition("block").sortWithinPartitions("block").mapInArrow(packed, "block int, leaf int, data binary, node binary"), "blocks")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node = None, None
        for b in batches:
            for leaf, data in zip(b["leaf"].to_pylist(), b["node"].to_pylist(), strict=True):
                if leaf != now and node is not None:
                    yield as_batch(leaf=pa.array([now], pa.int32()), node=pa.array([pickle.dumps(node)], pa.binary()))
                node = pickle.loads(data) if leaf != now else node.merged(pickle.loads(data))
                now = leaf
        if node is not None:
            yield as_batch(leaf=pa.array([now], pa.int32()), node=pa.array([pickle.dumps(node)], pa.binary()))

    heap: list[Nodes | None] = [None] * (2 * (1 << depth) - 1)
    merged = blocks.select("leaf", "node").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(leaves, "leaf int, node binary")
    for r in merged.collect():  # at most 2**depth rows of four vectors
        heap[(1 << depth) - 1 + r["leaf"]] = pickle.loads(r["node"])
    for c in range((1 << depth) - 2, -1, -1):
        two = [heap[d] for d in (2 * c + 1, 2 * c + 2) if heap[d] is not None]
        heap[c] = two[0].merged(two[1]) if len(two) == 2 else two[0] if two else None
    tree = spark.sparkContext.broadcast(heap)

    asking = all_rows.where(anchors).dropDuplicates(["id", "label", "x"])
    few = {r["leaf"]: r["count"] for r in asking.groupBy("leaf").count().collect()}  # at most 2**depth rows
    first, split, bunches, held = {}, {}, 0, 0
    for leaf in sorted(few):  # neighbouring leaves share a bunch while there is room, large ones are split
        if held + few[leaf] > p.bunch and held:
            bunches, held = bunches + 1, 0
        first[leaf], split[leaf], held = bunches, -(-few[leaf] // p.bunch), held + few[leaf]
        if split[leaf] > 1:
            bunches, held = bunches + split[leaf], 0
    if not few:
        return empty
    numbered = asking.withColumn("bunch", (by_leaf(first) + F.pmod(F.xxhash64("id", "x"), by_leaf(split))).cast("int")).withColumn("a", F.row_number().over(W.partitionBy("bunch").orderBy("leaf", "id", "label", "x")).cast("long"))
    asks = scratch.cut(numbered.withColumn("bands", F.expr(f"array(named_struct('floor', {-OPEN}L, 'ceil', {OPEN}L))")), "anchors")

    def bunched(asks: DataFrame, k: int, beat: DataFrame | None) -> DataFrame:
        """A row for each bunch (bunch, data); ``beat`` has k-th scores by (bunch, a, band)."""
        if beat is not None:
            told = beat.groupBy("bunch", "a").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("beat"))  # at most a band's worth each
            asks = asks.join(told, ["bunch", "a"], "left")
        else:
            asks = asks.withColumn("beat", F.lit(None).cast("map<int,bigint>"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, rows = None, []

            def row() -> pa.RecordBatch:
                width = max(len(r["bands"]) for r in rows)
                bands = lambda c, none: np.array([[x[c] for x in r["bands"]] + [none] * (width - len(r["bands"])) for r in rows], np.int64).reshape(len(rows), width)
                floor, ceil, lowest = bands("floor", 0), bands("ceil", -1), np.full((len(rows), width), -OPEN)
                for i, r in enumerate(rows):
                    for band, score in r["beat"] or ():
                        lowest[i, band] = score
                x = np.frombuffer(b"".join(r["x"] for r in rows), kind).reshape(len(rows), dim)
                column = lambda c: np.array([r[c] for r in rows], np.int64)
                return as_batch(bunch=pa.array([now], pa.int32()), data=pa.array([pickle.dumps(Bunch(column("a"), column("id"), column("label"), x, floor, ceil, lowest, k, p.group))], pa.binary()))

            for b in batches:
                for r in b.to_pylist():
                    if r["bunch"] != now and rows:
                        yield row()
                        rows.clear()
                    now = r["bunch"]
                    rows.append(r)
            if rows:
                yield row()

        return asks.repartition("bunch").sortWithinPartitions("bunch", "a").select("bunch", "a", "id", "label", "x", "bands", "beat").mapInArrow(pack, "bunch int, data binary")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bunch, data in zip(b["bunch"].to_pylist(), b["data"].to_pylist(), strict=True):
                left = walk(pickle.loads(data), tree.value)
                yield as_batch(bunch=pa.array([bunch] * len(left), pa.int32()), leaf=pa.array(list(left), pa.int32()), most=pa.array(list(left.values()), pa.float64()))

    slices = max(1, -(-many // p.slice))

    def scored(bunches: DataFrame, pairs: DataFrame, same: bool) -> DataFrame:
        """The best of each anchor's bands among the leaves that it is paired with, by slice."""
        start = by_leaf(starts)
        at = pairs.withColumn("block", F.explode(F.sequence(start, start + by_leaf(parts) - 1))).withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
        theirs = at.join(blocks.select("block", "data"), "block").select("bunch", "slice", (-F.col("most")).alias("order"), "block", "data")
        ours = at.select("bunch", "slice").distinct().join(bunches, "bunch").select("bunch", "slice", F.lit(float("-inf")).alias("order"), F.lit(-1).alias("block"), "data")
        both = ours.unionByName(theirs).repartition("bunch", "slice").sortWithinPartitions("bunch", "slice", "order", "block")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bunch = None, None
            for b in batches:
                for r in range(b.num_rows):
                    number, block, data = b["bunch"][r].as_py(), b["block"][r].as_py(), pickle.loads(b["data"][r].as_py())
                    if block < 0:
                        if bunch is not None:
                            yield bunch.found(now)
                        now, bunch = number, data
                    else:
                        bunch.look(*data, same)
            if bunch is not None:
                yield bunch.found(now)

        return both.mapInArrow(run, ASKS)

    def best(found: DataFrame, k: int) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("bunch", "a", "band").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", nth).where(F.col("rank") <= k)

    def search(asks: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """bunch, a, band, rank, id, score: the ``k`` best of every band."""
        own = asks.select("bunch", "leaf").distinct().withColumn("most", F.lit(0.0))
        seeds = scratch.cut(best(scored(scratch.cut(bunched(asks, k, None), f"{name}-first"), own, same), k), f"{name}-seeds")
        second = scratch.cut(bunched(asks, k, seeds.where(F.col("rank") == k)), f"{name}-second")
        left = scratch.cut(second.mapInArrow(reach, "bunch int, leaf int, most double").join(own.select("bunch", "leaf"), ["bunch", "leaf"], "left_anti"), f"{name}-left")
        more = scored(second, left, same)
        return best(seeds.drop("rank").unionByName(more.select(*seeds.drop("rank").columns)), k)

    positives = scratch.cut(search(asks, k_positive, True, "positives").select("bunch", "a", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # ceil(0.8 * score) in integers
    score = "x.positive_score"
    band = f"named_struct('floor', -((-80 * {score} - pmod(-80 * {score}, 100)) div 100), 'ceil', {score})"
    bands = positives.groupBy("bunch", "a").agg(F.array_sort(F.collect_list(F.struct("band", "positive_score"))).alias("p")).select("bunch", "a", F.expr(f"transform(p, x -> {band})").alias("bands"))
    asks = scratch.cut(asks.drop("bands").join(bands, ["bunch", "a"]), "asks")
    negatives = search(asks, k_negative, False, "negatives").select("bunch", "a", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(asks.select("bunch", "a", F.col("id").alias("anchor_id")), ["bunch", "a"])
    return negatives.join(named, ["bunch", "a", "band"]).select(*empty.columns)


def query(spark: SparkSession, sf_dir: str, p: TreeParams = TreeParams()) -> DataFrame:
    """op11: hard negatives of every hundredth vector, labels of every seventh moved by one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark, known(table, "vec_id", label, "embedding"), F.col("id") % 100 == 0, p=p)


SQL = """
WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS s FROM v a, v b WHERE a.id % 100 = 0),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM (
  SELECT p.a, p, b, ps, s, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b) AS rank FROM p JOIN s ON p.a = s.a AND NOT same WHERE 80 * ps <= 100 * s AND 100 * s <= 100 * ps) WHERE rank <= 5
"""
