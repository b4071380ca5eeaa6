"""Merkle manifest of a dataset: a tree a group, a tree over the groups' roots, and a proof for every row.

Rows are range-sorted by group and order, so a group lies in neighbouring partitions. A row's place in its group is the
partition's offset for that group (the sum of the counts of the partitions before it) and its number within the
partition. A partition builds every node all of whose leaves it holds, up to aligned subtrees of 2**LEVELS leaves; what is
left are its ragged boundary nodes. These, and they alone, are shuffled by coordinate, the aligned block of 2**LEVELS nodes
that they lie in, and finished there, LEVELS levels at a time, until every group has its root. A proof is put together
downwards: the siblings above a boundary node are joined to the node, then to the rows below it, so no join has a key with
more rows than a block, and no task more than a block of nodes at a time, however many rows a group has.

A node is the lower-case hex SHA-256 of its one or two children's hex digests. Groups and rows are in ascending order, nulls
first, strings by their bytes. Rows of one group and order are ordered by leaf; equal rows are equal leaves side by side, each
with its own proof. Null texts count as ``-``, empty ones as ``0:``, very long ones are hashed whole. An empty table gives no
rows. Other columns than the five of the manifest aren't read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, as_batch

#: levels that a pass finishes: a task holds 2**LEVELS nodes of a level at most
LEVELS = 16
#: bytes of proofs of boundary nodes up to which they are broadcast to the rows below them
BROADCAST_BYTES = 16 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def node(*children: str) -> str:
    """H: lower-case hex SHA-256 of the hex digests, one after the other."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of a row's fields: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    said = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said).cast("binary"), 256)


class Piece:
    """Nodes of one group within an aligned block, and all parents that they have the children for, up to level ``top``."""

    def __init__(self, total: int, top: int) -> None:
        self.total, self.top, self.levels = total, top, {}

    def width(self, level: int) -> int:
        """Nodes that the whole tree has on a level."""
        return -(-self.total >> level)

    def add(self, level: int, at: int, digest: str) -> None:
        self.levels.setdefault(level, {})[at] = digest

    def build(self) -> None:
        for level in range(min(self.levels), self.top):
            here, width = self.levels.get(level, {}), self.width(level)
            if width == 1:  # the root
                break
            up = self.levels.setdefault(level + 1, {})
            for at, digest in here.items():
                if at & 1:
                    if at - 1 in here:
                        up[at >> 1] = node(here[at - 1], digest)
                elif at + 1 == width:
                    up[at >> 1] = node(digest)

    def climb(self, level: int, at: int) -> tuple[bytes, int, int, str]:
        """The siblings on the way up from a node, and the node where the way ends."""
        found = []
        while level < self.top and self.width(level) > 1 and at >> 1 in self.levels.get(level + 1, ()):
            if (sibling := self.levels[level].get(at ^ 1)) is not None:
                found.append(bytes.fromhex(sibling))
            level, at = level + 1, at >> 1
        return b"".join(found), level, at, self.levels[level][at]


def _climbed(nodes: DataFrame, top: int) -> DataFrame:
    """``nodes`` (g, total, level, at, digest, sorted by group and place) with the siblings up to the last node that its task can
    make: ``sib``, ``up_level``, ``up_at``, ``up_digest``. A piece is what follows without a gap within an aligned block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, piece, key, after = [], None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if waiting:
                piece.build()
                rows = pa.Table.from_batches(waiting).combine_chunks()
                ways = [piece.climb(level, at) for level, at in zip(rows["level"].to_pylist(), rows["at"].to_pylist(), strict=True)]
                told = dict(zip(("sib", "up_level", "up_at", "up_digest"), (pa.array(x, t) for x, t in zip(zip(*ways, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)), strict=True))
                for b in rows.to_batches(4096):
                    yield pa.RecordBatch.from_arrays([*b.columns, *(told[c].slice(0, b.num_rows) for c in told)], names=[*rows.column_names, *told])
                    told = {c: x.slice(b.num_rows) for c, x in told.items()}

        for b in batches:
            start, cols = 0, (b[c].to_pylist() for c in ("g", "total", "level", "at", "digest"))
            for k, (g, total, level, at, digest) in enumerate(zip(*cols, strict=True)):
                first = at << level
                if (g, first >> top) != key or first != after:
                    if k > start:
                        waiting.append(b.slice(start, k - start))
                    yield from done()
                    waiting, start, piece, key = [], k, Piece(total, top), (g, first >> top)
                piece.add(level, at, digest)
                after = min(at + 1 << level, total)
            if b.num_rows > start:
                waiting.append(b.slice(start))
        yield from done()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", sib binary, up_level int, up_at bigint, up_digest string"
    return nodes.mapInArrow(run, schema)


def _placed(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (g, digest, and others) with ``total``, the size of their group, and ``at``, their place in it by ``order``."""
    # equal rows are dealt to several partitions by their number, which decides nothing else
    keys = ["g", *order, "digest"]
    numbered = rows.withColumn("_salt", F.monotonically_increasing_id())
    by = scratch.cut(numbered.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt").withColumn("_id", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("_id", 33)
    # a row for each group in each partition: at most groups and partitions together
    counts = by.groupBy(F.col("g").alias("_g"), part.alias("_p")).agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    # sums over sums, as a group may lie in all partitions but has one row in each
    before = F.sum("n").over(W.partitionBy("_g").orderBy("_p")) - F.col("n") - F.col("first")
    counts = scratch.cut(counts.select("_g", "_p", before.alias("_offset"), F.sum("n").over(W.partitionBy("_g")).alias("total")), f"{name}-counts")
    few = counts.count() * 64 <= BROADCAST_BYTES
    told = by.join(F.broadcast(counts) if few else counts, (part == F.col("_p")) & F.col("g").eqNullSafe(F.col("_g")))
    return told.withColumn("at", F.col("_id") + F.col("_offset")).drop("_g", "_p", "_id", "_offset").sortWithinPartitions("g", "at")


#: the first node below a boundary node stands for it as an input of the next pass
FIRST = "shiftleft(at, level) = shiftleft(up_at, up_level)"


def forest(scratch: Scratch, rows: DataFrame, order: list[str], name: str, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees over ``rows`` (g, digest, the columns of ``order`` and others). Two tables: the rows with total, at, and sib, their siblings up
    to a node (up_level, up_at) of the other table; and these nodes with rest, the siblings above them, and root, their group's."""
    low = scratch.cut(_climbed(_placed(scratch, rows, order, name).withColumn("level", F.lit(0)), levels), f"{name}-low")
    largest = low.agg(F.max("total")).first()[0] or 1
    passes, top, below = [], levels, low
    while not passes or (largest - 1) >> (top - levels):
        nodes = below.where(FIRST).select("g", "total", F.col("up_level").alias("level"), F.col("up_at").alias("at"), F.col("up_digest").alias("digest"))
        dealt = nodes.repartition("g", F.expr(f"shiftright(shiftleft(at, level), {top})")).sortWithinPartitions("g", F.expr("shiftleft(at, level)"))
        below = scratch.cut(_climbed(dealt, top), f"{name}-up{top}")
        passes.append(below)
        top += levels
    above = None
    for one in reversed(passes):
        own = one.select("g", "total", "level", "at", F.col("sib").alias("rest"), "up_level", "up_at", F.col("up_digest").alias("root"))
        if above is not None:
            own = joined(own.drop("root"), above).withColumn("rest", F.concat("rest", "above_rest"))
        above = own.select("g", "total", F.col("level").alias("up_level"), F.col("at").alias("up_at"), "rest", "root")
    return low, above


def joined(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` with what the nodes that their ways end at have: above_rest and the columns that rows lack."""
    more = [c for c in above.columns if c not in ("g", "total", "up_level", "up_at", "rest")]
    told = above.select(F.col("g").alias("_g"), F.col("up_level").alias("_l"), F.col("up_at").alias("_a"), F.col("rest").alias("above_rest"), *more)
    return rows.join(told, F.col("g").eqNullSafe(F.col("_g")) & (F.col("up_level") == F.col("_l")) & (F.col("up_at") == F.col("_a"))).drop("_g", "_l", "_a")


def refold(digest: str, at: int, total: int, siblings: bytes) -> str:
    """The root that a digest at a place of a tree of ``total`` leaves and its siblings, bottom up, give."""
    k = 0
    while total > 1:
        if at & 1 or at + 1 < total:
            other, k = siblings[k : k + 32].hex(), k + 32
            digest = node(other, digest) if at & 1 else node(digest, other)
        else:
            digest = node(digest)
        at, total = at >> 1, (total + 1) >> 1
    return digest


def manifest(spark: SparkSession, rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` (g, digest, doc_id and others) with at, total, subroot and proof of their group's tree, and top_at, top_total,
    top_proof and root of the tree over the groups."""
    scratch = Scratch(spark)
    low, above = forest(scratch, rows, ["doc_id"], "rows", levels)
    subroots = above.where("shiftleft(up_at, up_level) = 0").select(F.lit("").alias("g"), F.col("g").alias("lang"), F.col("root").alias("digest"))
    top_low, top_above = forest(scratch, subroots, ["lang"], "top", levels)
    tops = joined(top_low, top_above).select(F.col("lang").alias("_lang"), F.col("at").alias("top_at"), F.col("total").alias("top_total"), F.concat("sib", "above_rest").alias("top_proof"), F.col("root").alias("top"))
    # to boundary nodes first, of which a group has few, then to rows
    nodes = above.join(tops, F.col("g").eqNullSafe(F.col("_lang"))).select("g", "up_level", "up_at", "rest", F.col("root").alias("subroot"), "top_at", "top_total", "top_proof", F.col("top").alias("root"))
    nodes = scratch.cut(nodes, "nodes")
    size = nodes.agg(F.sum(F.octet_length("rest") + F.octet_length("top_proof") + 300)).first()[0] or 0
    return joined(low, F.broadcast(nodes) if size <= BROADCAST_BYTES else nodes).withColumn("proof", F.concat("sib", "above_rest")).drop("sib", "above_rest", "level", "up_level", "up_at", "up_digest")


def query(spark: SparkSession, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    """op12: the manifest of ``documents`` by lang, and whether rows of which a seventh is tampered with still fold to its root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull(), leaf(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS)))
    found = manifest(spark, docs.select(F.col("lang").alias("g"), "doc_id", leaf(*map(F.col, FIELDS)).alias("digest"), tampered.alias("tampered")), levels)

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b[c].to_pylist() for c in ("digest", "tampered", "at", "total", "proof", "top_at", "top_total", "top_proof", "root")]
            folded = [refold(refold(t or d, at, n, p), up, m, q) for d, t, at, n, p, up, m, q, _ in zip(*cols, strict=True)]
            proofs = [hashlib.sha256((p + q).hex().encode()).hexdigest() for p, q in zip(cols[4], cols[7], strict=True)]
            yield as_batch(doc_id=b["doc_id"], leaf=b["digest"], subroot=b["subroot"], root=b["root"], proof_sha256=pa.array(proofs, pa.string()), folded_root=pa.array(folded, pa.string()), verified=pa.array([x == r for x, r in zip(folded, cols[8], strict=True)], pa.bool_()))

    return found.mapInArrow(proven, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + ")"
SQL = f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(range(0, 8), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k) AS c FROM range(0, 256) r(k))),
d AS (SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, * FROM (
  SELECT doc_id, lang, {_LEAF} AS leaf, {_LEAF.replace("n_chars::", "(n_chars + 1)::")} AS changed,
         xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS tampered
  FROM documents, tab)),
tree AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS l FROM d GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM tree WHERE len(l) > 1),
sub AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS top_at FROM tree WHERE len(l) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY top_at) AS l FROM sub
  UNION ALL SELECT lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM top WHERE len(l) > 1),
steps AS (SELECT lang, lvl, l FROM tree WHERE len(l) > 1),
height AS (SELECT s.lang, coalesce(max(lvl) + 1, 0) AS h FROM sub s LEFT JOIN steps ON s.lang IS NOT DISTINCT FROM steps.lang GROUP BY s.lang),
way AS (SELECT lang, pos, lvl, l[xor(pos >> lvl, 1) + 1] AS other, (pos >> lvl) & 1 AS odd FROM d JOIN steps USING (lang)
  UNION ALL SELECT d.lang, pos, lvl, l[xor(pos >> lvl, 1) + 1], (pos >> lvl) & 1 FROM d JOIN steps ON d.lang IS NULL AND steps.lang IS NULL
  UNION ALL SELECT d.lang, pos, h + lvl, l[xor(top_at >> lvl, 1) + 1], (top_at >> lvl) & 1 FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang JOIN height ON d.lang IS NOT DISTINCT FROM height.lang, top WHERE len(top.l) > 1),
proofs AS (SELECT lang, pos, list(coalesce(other, '') ORDER BY lvl) AS others, list(odd ORDER BY lvl) AS odds FROM way GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(others, ''), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM (
  SELECT d.doc_id, d.leaf, sub.subroot, (SELECT l[1] FROM top WHERE len(l) = 1) AS root, others,
         list_reduce(range(1, coalesce(len(others), 0) + 1), lambda c, k: sha256(CASE WHEN odds[k] = 1 THEN others[k] || c ELSE c || others[k] END), CASE WHEN tampered THEN changed ELSE leaf END) AS folded
  FROM d JOIN sub ON d.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proofs ON d.lang IS NOT DISTINCT FROM proofs.lang AND d.pos = proofs.pos)
"""
