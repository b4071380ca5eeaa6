"""Neighbours that can become candidates, by what token sets share, so that not every vector is held against every other.

A pair needs a token overlap r by its thresholds, whatever its cosine. Tokens have one order, rare ones first by a bounded sample; two
sets that overlap by r share one of the first n - ceil(r n) + 1 of either (n: its size), at places that leave room for the rest.
Entries of these are grouped by token, and what meets there is held against floors: the k-th best of a vector among a sample of
all vectors is no better than its k-th best of all, so a pair below the floors of both sides is a neighbour of neither. The vectors of the
few pairs that are left are searched for exactly among all; equal vectors find each other by position. All steps are exact: samples only decide how
much is left. What is worked out is vectors times the sample of vectors, pairs within a token's entries, and few vectors times all.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from . import knn
from .matches import LONGS, bits, codes, possible, set_bits, unpacked
from .scratch import Scratch

#: snippets whose tokens are counted for the order, and how many frequent tokens are told apart
SAMPLE, FREQUENT = 160_000, 1 << 18
#: ranks of tokens, by the last bits of their hashes
RANKS = 1 << 22
#: vectors of the sample that gives floors: this times the root of all, at most MOST
FLOORS, MOST = 32, 1 << 16
#: vectors of that sample in a group
GROUP = 8
#: components of a vector that an entry carries at most, each as 16 bits; the error that this makes in a product at most
WIDTH, SLACK = 32, 2e-4
#: entries of a bucket on average; a token's entries are in one
BUCKET = 400_000
#: a token's entries from which they are held against each other as matrices
MATRIX = 48
#: width of a cell and of the box around a vector by which vectors of cosine 1 are found, and how many components are looked at
CELL, BOX, SEEN = 1e-2, 5e-5, 8


def needed(t: Thresholds) -> float:
    """The token overlap below which no pair can pass, as cosine is 1 at most."""
    by_blend = (min(t.func, t.win, t.exp) - (1 - t.lexical_weight)) / t.lexical_weight if t.lexical_weight > 0 else 0.0
    return max(t.lexical_min_ratio, by_blend)


def _ranks(snippets: DataFrame, key: str, col: str, read: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How frequent tokens are in a sample of snippets, by the last bits of their hashes: rare tokens may rank with frequent ones, which
    leaves the order one order."""
    many = snippets.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, n = np.unique(read(b[col])[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

    some = snippets.where(F.pmod(F.xxhash64(key), F.lit(max(1, many // SAMPLE))) == 0).select(col)
    found = some.mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where("n > 1")
    told = found.orderBy(F.desc("n"), "code").limit(FREQUENT).toArrow()
    ranks = np.zeros(RANKS, np.uint16)
    np.maximum.at(ranks, told["code"].to_numpy() % RANKS, np.minimum(told["n"].to_numpy(), 0xFFFF).astype(np.uint16))
    return ranks


def sketches(snippets: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """What is compared of token sets, for ``near`` and matches.candidates: their bits, and as ``first`` the hashes of their first tokens in order."""
    return bits(snippets, _first(_ranks(snippets, "pos", "tokens", codes), t))


def _first(ranks: np.ndarray, t: Thresholds) -> Callable[[np.ndarray, np.ndarray], list[bytes]]:
    r = needed(t) - 1e-9

    def first(n: np.ndarray, code: np.ndarray) -> list[bytes]:
        out, ends = [], np.cumsum(n)
        take = np.where(n > 0, np.minimum(n, n - np.ceil(r * n - 1e-6).astype(np.int64) + 1), 0)
        for at in range(0, len(n), 0x10000):  # a row's number, a token's count and its hash in one number
            size = n[at : at + 0x10000]
            part = code[ends[at] - n[at] : ends[at + len(size) - 1]]
            key = part.astype(np.uint64) | (np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(48))
            key |= ranks[part % np.uint32(RANKS)].astype(np.uint64) << np.uint64(32)
            key.sort()
            told = key.astype(np.uint32)  # the lower half is the hash
            out += [told[s : s + k].tobytes() for s, k in zip((np.cumsum(size) - size).tolist(), take[at : at + 0x10000].tolist(), strict=True)]
        return out

    return first


def sketcher(told: DataFrame, t: Thresholds, vec: Callable[[pa.RecordBatch], pa.Array]) -> Callable[[DataFrame], DataFrame]:
    """For rows of ``told`` (snippet_hash, codes, and others): a step that puts n, bits, ``first`` and what ``vec`` makes of rows in the place of codes, row by row."""
    first = _first(_ranks(told, "snippet_hash", "codes", unpacked), t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, code = unpacked(b["codes"])
            yield pa.RecordBatch.from_pydict({c: b[c] for c in b.schema.names if c != "codes"} | {"n": pa.array(n)} | set_bits(n, code) | {"first": pa.array(first(n, code), pa.binary()), "vec": vec(b)})

    def step(rows: DataFrame) -> DataFrame:
        own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "codes"]
        return rows.mapInArrow(run, ", ".join([*own, "n long", *(f"s{k} long" for k in range(LONGS)), "first binary", "vec array<double>"]))

    return step


def _floors(reps: DataFrame, k: int, least: float, many: int) -> DataFrame:
    """data, floor: for each distinct vector a bound that its k-th best among a sample of them reaches, or ``least``. The sample is cut into
    groups, and the k-th best of the groups' best ones is that bound: k of the sample reach it."""
    some = reps.orderBy(F.xxhash64("rep"), "rep").limit(min(MOST, int(FLOORS * many**0.5) + k)).toArrow()
    among = np.frombuffer(b"".join(some["data"].to_pylist()), float).reshape(some.num_rows, -1).astype(np.float32)
    groups = len(among) // GROUP
    told = reps.sparkSession.sparkContext.broadcast(among[: groups * GROUP].T.copy())  # at most MOST vectors
    error = (among.shape[1] + 8) * 6e-8 + 1e-8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                data = np.frombuffer(b"".join(b["data"].to_pylist()), float).reshape(b.num_rows, -1).astype(np.float32)
                floor = np.full(b.num_rows, least)
                for at in range(0, b.num_rows if groups >= k else 0, 64):
                    best = (data[at : at + 64] @ told.value).reshape(-1, GROUP, groups).max(axis=1)
                    floor[at : at + 64] = np.maximum(least, np.partition(best, -k, axis=1)[:, -k] - error)
                yield pa.RecordBatch.from_arrays([b["data"], pa.array(floor)], names=["data", "floor"])

    return reps.select("rep", "data").mapInArrow(run, "data binary, floor double")


def _entry(width: int) -> np.dtype:
    return np.dtype([("token", "<u4"), ("ent", "<i8"), ("n", "<i4"), ("rest", "<i4"), ("floor", "<f4"), ("q", "<i2", (width,))])


def _entries(keyed: DataFrame, width: int, buckets: int) -> DataFrame:
    """bucket, entries: the entries of (ent, data, floor, n, first) by hash, as bytes."""
    kind = _entry(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b["first"].to_pylist()
            size = np.array([len(x) // 4 for x in first], np.int64)
            out = np.empty(int(size.sum()), kind)
            row = np.repeat(np.arange(b.num_rows), size)
            n = b["n"].to_numpy()
            out["token"], out["ent"], out["n"] = np.frombuffer(b"".join(first), np.uint32), b["ent"].to_numpy()[row], n[row]
            out["rest"] = n[row] - (np.arange(len(row)) - (np.cumsum(size) - size)[row])
            out["floor"] = b["floor"].to_numpy()[row] - SLACK
            data = np.frombuffer(b"".join(b["data"].to_pylist()), float).reshape(b.num_rows, -1)
            out["q"] = np.rint(data * 32767).astype(np.int16)[row]
            part = out["token"] % buckets
            order = np.argsort(part, kind="stable")
            out, part = out[order], part[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
            blobs = [x.tobytes() for x in np.split(out, starts[1:])] if len(part) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    return keyed.select("ent", "data", "floor", "n", "first").mapInArrow(run, "bucket int, entries binary")


def meet(e: np.ndarray, r: float, t: Thresholds) -> dict[str, np.ndarray]:
    """Pairs a < b of entries with one token that may pass, once each: a, b, cosine (no lower than it is), asks_a and asks_b, whether
    it reaches that side's floor."""
    # most tokens stand alone, so that nothing meets there
    slot = (e["token"] * np.uint32(2654435761)) >> np.uint32(12)
    order = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] > 1)
    order = order[np.argsort((e["token"][order].astype(np.uint64) << np.uint64(32)) | e["n"][order].astype(np.uint64))]
    token, ent, n, rest, floor = e["token"][order], e["ent"][order], e["n"][order].astype(np.int64), e["rest"][order].astype(np.int64), e["floor"][order]
    vec, share = e["q"][order].astype(np.float32) / np.float32(32767), r / (1 + r)
    widest = np.floor(rest / share + 1e-6).astype(np.int64) - n  # the size that the larger set may have
    least = min(t.func, t.win, t.exp)
    found = []

    def keep(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        both, size = np.minimum(rest[i], rest[j]), n[i] + n[j]  # at the first token that two sets share, all that they share is among the rest
        ok = (both >= share * size - 1e-6) & (ent[i] != ent[j])
        ok &= (1 - t.lexical_weight) * (s + SLACK) + t.lexical_weight * both / (size - both) >= least - 1e-6
        if ok.any():
            i, j, s = i[ok], j[ok], s[ok]
            turn = ent[i] > ent[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            found.append((ent[i], ent[j], s.astype(float) + SLACK, s >= floor[i], s >= floor[j]))

    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(token)][: len(starts)]
    # few entries: each with the next one, with the one after that, and so on, for all tokens at once
    small = np.repeat(ends - starts < MATRIX, ends - starts)
    last = np.repeat(ends, ends - starts)
    i, step = np.flatnonzero(small), 1
    while len(i):
        i = i[i + step < last[i]]
        i = i[n[i + step] <= widest[i]]
        for at in range(0, len(i), 200_000):
            x = i[at : at + 200_000]
            y = x + step
            ok = rest[y] >= share * (n[x] + n[y]) - 1e-6
            x, y = x[ok], y[ok]
            s = np.einsum("ij,ij->i", vec[x], vec[y])
            ok = (s >= floor[x]) | (s >= floor[y])
            keep(x[ok], y[ok], s[ok])
        step += 1
    for start, end in zip(starts[ends - starts >= MATRIX].tolist(), ends[ends - starts >= MATRIX].tolist(), strict=True):
        size = n[start:end]
        smaller = start + np.flatnonzero(widest[start:end] >= size)
        for at in range(0, len(smaller), knn.TILE[0]):
            x = smaller[at : at + knn.TILE[0]]
            lo, hi = start + np.searchsorted(size, n[x[0]]), start + np.searchsorted(size, widest[x].max(), "right")
            # a token that comes late in the larger set has no room for a smaller one of about its size
            larger = lo + np.flatnonzero(rest[lo:hi] >= share * (n[x[0]] + n[lo:hi]) - 1e-6)
            for y in (larger[k : k + knn.TILE[1]] for k in range(0, len(larger), knn.TILE[1])):
                s = vec[x] @ vec[y].T
                i, j = np.divmod(np.flatnonzero((s >= floor[x][:, None]) | (s >= floor[y][None])), len(y))
                keep(x[i], y[j], s[i, j])
    names = ("a", "b", "cosine", "asks_a", "asks_b")
    if not found:
        return dict(zip(names, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)), strict=True))
    cols = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort((cols[1], cols[0]))
    cols = [x[order] for x in cols]
    fresh = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
    return dict(zip(names, (x[fresh] for x in cols), strict=True))


def _met(entries: DataFrame, width: int, buckets: int, r: float, t: Thresholds) -> DataFrame:
    """What meets in buckets: a, b, cosine, asks_a, asks_b."""
    kind = _entry(width)

    def told(blobs: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in meet(np.frombuffer(b"".join(blobs), kind), r, t).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            for bucket, blob in zip(b["bucket"].to_pylist(), b["entries"].to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield told(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield told(blobs)

    met = entries.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return met.mapInArrow(run, "a long, b long, cosine double, asks_a boolean, asks_b boolean").groupBy("a", "b").agg(F.max("cosine").alias("cosine"), F.max("asks_a").alias("asks_a"), F.max("asks_b").alias("asks_b"))


def _alike(reps: DataFrame) -> DataFrame:
    """rep of the vectors in whose cell others are: all whose cosine with another one rounds to 1, and perhaps more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            data = np.frombuffer(b"".join(b["data"].to_pylist()), float).reshape(b.num_rows, -1)[:, :SEEN]
            lo, hi = (np.floor((data + x) / CELL).astype(np.int32) for x in (-BOX / 2, BOX / 2))
            cells, of = [x.tobytes() for x in lo], list(range(b.num_rows))
            for i in np.flatnonzero((lo != hi).any(axis=1)).tolist():
                for corner in itertools.islice(itertools.product(*(sorted({x, y}) for x, y in zip(lo[i].tolist(), hi[i].tolist(), strict=True))), 1, None):
                    cells.append(np.array(corner, np.int32).tobytes())
                    of.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.binary()), b["rep"].take(pa.array(of))], names=["cell", "rep"])

    cells = reps.select("rep", "data").mapInArrow(run, "cell binary, rep long")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    return cells.join(shared, "cell", "left_semi").select("rep").distinct()


#: (rows that ask, (told, reps)) to (a_pos, b_pos, score)
Answer = Callable[[DataFrame, tuple[DataFrame, DataFrame]], DataFrame]


def searched(snippets: DataFrame, k: int, least: float | None) -> Answer:
    """All that ask are held against all."""

    def answer(asks: DataFrame, distinct: tuple[DataFrame, DataFrame] | None) -> DataFrame:
        flagged = snippets.select("pos", "vec").join(asks.select("pos", F.lit(True).alias("asks")), "pos", "left").withColumn("floor", F.lit(float("inf")))
        return knn.ask(flagged, k, least, distinct=distinct)[0].select("a_pos", "b_pos", "score")

    return answer


def near(snippets: DataFrame, k: int, least: float | None, t: Thresholds = Thresholds(), narrow: DataFrame | None = None, answer: Answer | None = None) -> DataFrame:
    """a_pos, b_pos, score of the ``k`` best of each row (pos, vec, tokens), as knn.knn gives them: all that can pass the thresholds, and
    few others. Where thresholds ask for little overlap or vectors are wide, all are searched for. ``narrow``: the rows' sketches, where they are written already.
    ``answer`` gives the k best of all rows whose vector is that of a row which asks, by those rows and the distinct vectors; else they are searched for."""
    r, spark = needed(t), snippets.sparkSession
    if k <= 0 or r < 0.5 or least is None or least <= 0:
        return knn.knn(snippets.select("pos", "vec"), k, least).select("a_pos", "b_pos", "score")
    scratch = Scratch(spark)
    told, reps = distinct = knn._distinct(scratch, snippets.select("pos", "vec"))
    many, size = knn._sized(reps)
    if not many or size // 8 > WIDTH:
        return knn.knn(snippets.select("pos", "vec"), k, least).select("a_pos", "b_pos", "score")
    width = size // 8
    # rows of one vector and one token set are looked at once
    narrow = scratch.cut(sketches(snippets, t), "bits") if narrow is None else narrow
    ents = told.join(narrow.select("pos", "set"), "pos").groupBy("data", "set").agg(F.min("pos").alias("ent"))
    first = narrow.select(F.col("pos").alias("ent"), F.col("n").cast("int").alias("n"), "first")
    keyed = scratch.cut(ents.join(_floors(reps, k, least, many), "data").join(first, "ent").select("ent", "data", "floor", "n", "first"), "keyed", "zstd")
    total = keyed.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-total // (4 * BUCKET)))
    met = scratch.cut(_met(_entries(keyed, width, buckets), width, buckets, r - 1e-9, t), "met")
    left = possible(met.toDF("a_pos", "b_pos", "cosine", "asks_a", "asks_b"), narrow, t)
    # a vector asks if a pair of it is left; so does one of several rows with others as near as these are to each other
    classes = scratch.cut(told.groupBy("data").agg(F.min("pos").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "classes")
    asks = left.where("asks_a").select(F.col("a_pos").alias("pos")).unionByName(left.where("asks_b").select(F.col("b_pos").alias("pos")))
    asks = scratch.cut(asks.unionByName(_alike(reps).withColumnRenamed("rep", "pos").join(classes.select(F.col("rep").alias("pos")), "pos", "left_semi")).distinct(), "asks")
    asking = told.join(asks, "pos", "left_semi").select("data").distinct()
    best = (answer or searched(snippets, k, least))(asks, distinct)
    # the others: rows of one vector are the best of each other, in order of position; a vector of zeros is near nothing
    of = told.where(F.col("data") != F.lit(bytes(size))).join(classes.drop("rep", "rows"), "data", "left_semi").join(asking, "data", "left_anti")
    of = scratch.cut(of.join(reps, "data").select("rep", "pos"), "same")
    lowest = of.withColumn("nth", F.row_number().over(W.partitionBy("rep").orderBy("pos"))).where(F.col("nth") <= k)
    same = of.withColumnRenamed("pos", "a_pos").join(lowest.select("rep", F.col("pos").alias("b_pos")), "rep").select("a_pos", "b_pos", F.lit(1.0).alias("score"))
    return best.select("a_pos", "b_pos", "score").unionByName(same)
