"""From neighbours to findings: blend, thresholds, overlap rules, one match a span pair, groups, clusters."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions import columns as C
from .components import connected_components
from .scratch import Scratch
from .upkeep import Clusters

#: longs of the bits that stand for a token set
LONGS = 8

SIDE = ("pos", "kind", "fn_id", "path", "fn_start", "fn_end", "start_line", "end_line")


def codes(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of token sets, and the tokens one after the other by a hash of 32 bits; tokens of one hash count as one."""
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    told = pc.list_flatten(tokens).dictionary_encode()
    code = np.array([zlib.crc32(x) for x in told.dictionary.cast(pa.binary()).to_pylist()], np.uint32)
    return n, code[told.indices.to_numpy(zero_copy_only=False)] if len(code) else np.zeros(0, np.uint32)


def unpacked(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``codes``, of sets that are hashes already, as bytes."""
    blobs = codes.to_pylist()
    return np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4, np.frombuffer(b"".join(blobs), np.uint32)


def set_bits(n: np.ndarray, code: np.ndarray) -> dict[str, pa.Array]:
    """s0, s1, ...: a bit for each token."""
    on = np.zeros((len(n), 64 * LONGS), bool)
    on[np.repeat(np.arange(len(n)), n), code % (64 * LONGS)] = True
    longs = np.ascontiguousarray(np.packbits(on, axis=1)).view(np.int64).reshape(len(n), LONGS)
    return {f"s{k}": pa.array(longs[:, k].copy()) for k in range(LONGS)}


def _bits(batches: Iterator[pa.RecordBatch], first: Callable[[np.ndarray, np.ndarray], list[bytes]] | None = None) -> Iterator[pa.RecordBatch]:
    """pos, n and s0, s1, ... of snippets (pos, tokens): the size of a token set, and a bit for each token; with ``first`` as ``bits`` has it."""
    for b in batches:
        n, code = codes(b["tokens"])
        told = {"pos": b["pos"], "n": pa.array(n), **set_bits(n, code)}
        yield pa.RecordBatch.from_pydict(told | ({"set": b["set"], "first": pa.array(first(n, code), pa.binary())} if first else {}))


def bits(snippets: DataFrame, first: Callable[[np.ndarray, np.ndarray], list[bytes]] = lambda n, code: [b""] * len(n)) -> DataFrame:
    """Of snippets (pos, tokens): pos, n (the size of a token set), s0, s1, ... (a bit for each token), set (a digest, alike for equal sets) and
    first (what ``first`` makes of sizes and hashes)."""
    told = snippets.select("pos", "tokens", F.unhex(F.sha2(F.coalesce(F.array_join("tokens", " "), F.lit("")), 256)).alias("set"))
    return told.mapInArrow(lambda batches: _bits(batches, first), "pos long, n long, " + ", ".join(f"s{k} long" for k in range(LONGS)) + ", set binary, first binary")


def possible(pairs: DataFrame, narrow: DataFrame, t: Thresholds) -> DataFrame:
    """The pairs (a_pos, b_pos, cosine, ...) that may pass the thresholds by what two sets can share at most: a bit that one set has and
    the other hasn't is a token that they don't share. ``narrow`` has the bits. More columns: same, whether the sets are equal, and
    size, that of a's set."""
    n, m = (narrow.drop("first").select(*[F.col(c).alias(f"{x}_{c}") for c in narrow.columns if c != "first"]) for x in "ab")
    without = lambda x, y: F.col(f"{x}_n") - sum((F.bit_count(F.col(f"{x}_s{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_s{k}")))) for k in range(LONGS)), F.lit(0))
    both = F.least(without("a", "b"), without("b", "a"))
    most = F.when((F.col("a_n") == 0) | (F.col("b_n") == 0), 0.0).otherwise(C.let(both, lambda z: z / (F.col("a_n") + F.col("b_n") - z)))
    d = pairs.join(n, "a_pos").join(m, "b_pos").withColumn("most", most)
    d = d.where((F.col("most") >= t.lexical_min_ratio) & ((1 - t.lexical_weight) * F.col("cosine") + t.lexical_weight * F.col("most") >= min(t.func, t.win, t.exp) - 1e-9))
    return d.select(*pairs.columns, (F.col("a_set") == F.col("b_set")).alias("same"), F.col("a_n").alias("size"))


def candidates(snippets: DataFrame, near: DataFrame, t: Thresholds = Thresholds(), narrow: DataFrame | None = None, tokens: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Directed pairs (a_*, b_*, cosine, lexical, similarity) that pass the lexical floor and the neighbour's threshold.

    ``snippets`` has pos, tokens and the columns of SIDE; what is ranked is narrow, the rest is joined back here. ``narrow``: their bits, where they are written already.
    ``tokens`` gives pos and tokens of few rows (pos); else ``snippets`` has them as a column."""
    scratch, s = Scratch(snippets.sparkSession), snippets.select(*SIDE, "snippet_hash")
    a, b = (s.select(*[F.col(c).alias(f"{x}_{c}") for c in s.columns]) for x in "ab")
    d = near.select("a_pos", "b_pos", F.col("score").alias("cosine")).where("a_pos <> b_pos")
    # most pairs are ruled out before tokens are moved, and equal sets need none
    d = scratch.cut(possible(d, scratch.cut(bits(snippets), "bits") if narrow is None else narrow, t), "possible")
    other = d.where("not same").drop("same", "size")
    asked = scratch.cut(other.select(F.explode(F.array("a_pos", "b_pos")).alias("pos")).distinct(), "other")
    few = F.broadcast(asked) if asked.count() <= 1_000_000 else asked
    words = scratch.cut(tokens(few) if tokens else snippets.select("pos", "tokens").join(few, "pos", "left_semi"), "words")
    other = other.join(words.toDF("a_pos", "a_tokens"), "a_pos").join(words.toDF("b_pos", "b_tokens"), "b_pos")
    other = other.select("a_pos", "b_pos", "cosine", C.jaccard(F.col("a_tokens"), F.col("b_tokens")).alias("lexical"))
    d = d.where("same").select("a_pos", "b_pos", "cosine", F.when(F.col("size") == 0, 0.0).otherwise(1.0).alias("lexical")).unionByName(other)
    d = d.join(a, "a_pos").join(b, "b_pos").where("a_snippet_hash <> b_snippet_hash")
    d = d.withColumn("similarity", (1 - t.lexical_weight) * F.col("cosine") + t.lexical_weight * F.col("lexical"))
    if t.lexical_min_ratio > 0:
        d = d.where(F.col("lexical") >= t.lexical_min_ratio)
    least = F.when(F.col("b_kind") == "FUNC", t.func).when(F.col("b_kind") == "WIN", t.win).otherwise(t.exp)
    return d.where(F.col("similarity") >= least).drop("a_snippet_hash", "b_snippet_hash")


def apart() -> Column:
    """Whether a pair says something: disjoint ranges in one function, functions that don't overlap in one file."""
    col = F.col
    snippets = C.overlap_length(col("a_start_line"), col("a_end_line"), col("b_start_line"), col("b_end_line"))
    units = C.overlap_length(col("a_fn_start"), col("a_fn_end"), col("b_fn_start"), col("b_fn_end"))
    return F.when(col("a_fn_id") == col("b_fn_id"), snippets == 0).when(col("a_path") == col("b_path"), units == 0).otherwise(True)


def kind_rank() -> Column:
    """3 for two functions, 2 for two expansions, 1 for two windows, 0 for a mixed pair."""
    return F.when(F.col("a_kind") != F.col("b_kind"), 0).otherwise(F.when(F.col("a_kind") == "FUNC", 3).when(F.col("a_kind") == "EXP", 2).when(F.col("a_kind") == "WIN", 1).otherwise(0))


def matches(found: DataFrame, lexical_min_ratio: float = 0.0) -> DataFrame:
    """One row for each unordered pair of spans: the most similar, then of the higher kind; a is the lower side. Pairs may
    come from any search, so the lexical floor is held here once more."""
    kept = found.where(apart())
    kept = kept.where(F.col("lexical") >= lexical_min_ratio) if lexical_min_ratio > 0 else kept
    lower = F.struct("a_fn_id", "a_start_line", "a_end_line", "a_pos") <= F.struct("b_fn_id", "b_start_line", "b_end_line", "b_pos")
    sides = [F.when(lower, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in SIDE]
    d = kept.select(*sides, "cosine", "lexical", "similarity").withColumn("kind_rank", kind_rank())
    key = W.partitionBy(*[f"{x}_{c}" for x in "ab" for c in ("fn_id", "start_line", "end_line")])
    order = key.orderBy(F.desc("similarity"), F.desc("kind_rank"), "a_pos", "b_pos")
    return d.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


PAIR = ("fn_a", "fn_b")


def _one() -> Column:
    """A match as evidence has it."""
    return F.struct(F.col("a_start_line").alias("a_start"), F.col("a_end_line").alias("a_end"), F.col("b_start_line").alias("b_start"), F.col("b_end_line").alias("b_end"), "a_kind", "b_kind", "a_pos", "b_pos", "similarity", "cosine", "lexical")


def findings(found: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Groups of matches by unordered pair of functions: score, reasons, best match, n_evidence, and of either side the lines that are
    covered (the fewer are duplicated_lines), the first and last of them, and how many lie before and after the best match.

    A group is sums and one match; what it covers comes from its distinct spans, in order, each of which adds what lies beyond all
    before it. So a group of many matches is never one value; ``evidence`` has them."""
    has = lambda kind: (F.col("a_kind") == kind) | (F.col("b_kind") == kind)
    length = F.least(F.col("a_end_line") - F.col("a_start_line"), F.col("b_end_line") - F.col("b_start_line")) + 1
    d = found.groupBy(F.col("a_fn_id").alias("fn_a"), F.col("b_fn_id").alias("fn_b")).agg(
        F.max("similarity").alias("score"),
        F.max(F.when(has("FUNC"), F.col("similarity"))).alias("func"),
        F.max(F.when(has("EXP"), F.col("similarity"))).alias("exp"),
        F.count_if(has("WIN")).alias("hits"),
        F.count("*").cast("int").alias("n_evidence"),
        F.max_by(_one(), F.struct("kind_rank", length, "similarity", -F.col("a_pos"), -F.col("b_pos"))).alias("best"),
        F.min("a_path").alias("path_a"),
        F.min("b_path").alias("path_b"),
    )
    said = F.array(F.when(F.col("func") >= t.func, F.lit("func")), F.when(F.col("exp") >= t.exp, F.lit("exp")), F.when((F.col("hits") >= t.min_window_hits) & (F.col("hits") > 0), F.lit("window")))
    d = d.withColumn("reasons", F.filter(said, lambda x: x.isNotNull())).where(F.size("reasons") > 0).drop("func", "exp", "hits")
    return d.join(_covered(found, d.select(*PAIR, "best")), list(PAIR))


def _covered(found: DataFrame, groups: DataFrame) -> DataFrame:
    """duplicated_lines and, by side, first, last, before and after, of the groups."""
    side = lambda x: F.struct(F.lit(x).alias("side"), F.col(f"{x}_start_line").alias("s"), F.col(f"{x}_end_line").alias("e"))
    spans = found.select(F.col("a_fn_id").alias("fn_a"), F.col("b_fn_id").alias("fn_b"), F.explode(F.array(side("a"), side("b"))).alias("x")).select(*PAIR, "x.*").distinct()
    order = W.partitionBy(*PAIR, "side").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest("s", F.coalesce(F.max("e").over(order), F.lit(-1)) + 1)
    spans = spans.withColumn("s0", F.col("s")).withColumn("s", fresh).join(groups, list(PAIR))
    shown = lambda end: F.when(F.col("side") == "a", F.col(f"best.a_{end}")).otherwise(F.col(f"best.b_{end}"))
    lines = lambda s, e: F.sum(F.greatest(F.lit(0), e - s + 1)).cast("int")
    s, e = F.col("s"), F.col("e")
    each = spans.groupBy(*PAIR, "side").agg(lines(s, e).alias("n"), F.min("s0").alias("first"), F.max("e").alias("last"), lines(s, F.least(e, shown("start") - 1)).alias("before"), lines(F.greatest(s, shown("end") + 1), e).alias("after"))
    of = lambda c, x: F.max(F.when(F.col("side") == x, F.col(c))).alias(f"{c}_{x}")
    return each.groupBy(*PAIR).agg(F.min("n").alias("duplicated_lines"), *(of(c, x) for x in "ab" for c in ("first", "last", "before", "after")))


def evidence(found: DataFrame, groups: DataFrame) -> DataFrame:
    """The matches behind the findings, a row each, sorted by finding and place."""
    d = found.select(F.col("a_fn_id").alias("fn_a"), F.col("b_fn_id").alias("fn_b"), _one().alias("x")).join(groups.select(*PAIR), list(PAIR), "left_semi").select(*PAIR, "x.*")
    order = (*PAIR, "a_start", "a_end", "b_start", "b_end", "a_kind", "b_kind", "a_pos", "b_pos")
    return d.repartitionByRange(*order).sortWithinPartitions(*order)


def clusters(found: DataFrame, min_size: int = 2, kept: Clusters | None = None) -> DataFrame:
    """Findings with cluster, the least function of theirs, of clusters of at least ``min_size`` findings; all of them if ``min_size``
    is 1 or less. With ``kept`` only clusters that differ from those that it has are worked out."""
    edges = found.select(F.col("fn_a").alias("src"), F.col("fn_b").alias("dst"))
    label = kept.sync(edges) if kept else connected_components(edges)
    d = found.join(label, found["fn_a"] == label["node"]).drop("node")
    ids = d.groupBy("component").agg(F.count("*").alias("cluster_size"))
    ids = ids.where(F.col("cluster_size") >= min_size) if min_size > 1 else ids
    ids = ids.join(label.select("component").distinct(), "component")
    return d.join(ids, "component").withColumnRenamed("component", "cluster")
