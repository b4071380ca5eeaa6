"""Sharding by a lookup table that shards fill in turns.

Each shard prefers the slots of a prime-sized table in an order of its own (a permutation: slot s has rank
``(a * s + b) mod size``). Shards take turns; the one whose turn it is claims the free slot that it prefers most, until
no slot is free. All shards get equally many slots, give or take one, and few slots move if a shard comes or goes. A key
goes to the shard in the slot of its hash. The table has ``size`` rows whatever the data, so it is broadcast.

Built-in functions only: the table is one row's ``aggregate`` over the turns. A null key hashes as the empty text. Equal
keys go to one shard; nothing is shuffled, so a key with a third of all rows costs what other rows cost.
Very long keys are hashed whole, an empty table gives no rows, and other columns stay, except shard_slot and shard_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the table (a prime, far more than the shards) and number of shards of the query.
SIZE, SHARDS = 4093, 64


def _hash(text: str) -> str:
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint)"


def table(spark: SparkSession, names: list[str], size: int = SIZE) -> DataFrame:
    """slot, shard (place in ``names``): ``size`` rows. Preferences follow from a shard's name, so the table of fewer or
    more shards differs little. ``size`` must be a prime of at least the number of shards."""
    if not names or size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime, and at least the number of shards, of which there is one")
    shards = spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("k", "name")).selectExpr("k", f"{_hash("'a' || name")} % {size - 1} + 1 as a", f"{_hash("'b' || name")} % {size} as b")
    one = shards.agg(F.array_sort(F.collect_list(F.struct("k", "a", "b"))).alias("p"))  # one row: a bounded list
    best = f"array_min(transform(s.free, x -> struct((get(p, t % {len(names)}).a * x + get(p, t % {len(names)}).b) % {size} as r, x as x))).x"
    turn = f"transform(array({best}), c -> struct(filter(s.free, x -> x <> c) as free, concat(s.taken, array(c)) as taken))[0]"
    claims = f"aggregate(sequence(0L, {size - 1}L), struct(sequence(0L, {size - 1}L) as free, cast(array() as array<bigint>) as taken), (s, t) -> {turn}, s -> s.taken)"
    return one.selectExpr(f"posexplode({claims}) as (t, slot)").selectExpr("slot", f"cast(t % {len(names)} as int) as shard")


def place(df: DataFrame, key: str, names: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with shard_slot and shard_id, by a broadcast of the table. Columns of these names are replaced."""
    slots = table(df.sparkSession, names, size).select(F.col("slot").alias("shard_slot"), F.col("shard").alias("shard_id"))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    hashed = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % size
    kept = [c for c in df.columns if c not in slots.columns]
    told = df.select(*kept, hashed.alias("shard_slot"))
    return told.join(F.broadcast(slots), "shard_slot").select(*kept, "shard_slot", "shard_id")


def write_shards(df: DataFrame, key: str, names: list[str], path: str) -> None:
    """One folder a shard; a shard may have many files, so none is written by one task only."""
    place(df, key, names).write.partitionBy("shard_id").parquet(path)


def names_of(n: int) -> list[str]:
    return [f"shard-{k}" for k in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, shard_slot, shard_id of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", names_of(SHARDS))


SQL = f"""
WITH RECURSIVE p AS (SELECT k, ('0x' || substr(md5('ashard-' || k), 1, 8))::BIGINT % {SIZE - 1} + 1 AS a,
                            ('0x' || substr(md5('bshard-' || k), 1, 8))::BIGINT % {SIZE} AS b FROM range({SHARDS}) r(k)),
q AS (SELECT list(a ORDER BY k) AS a, list(b ORDER BY k) AS b FROM p),
turns AS (
  SELECT 0::BIGINT AS t, range({SIZE}) AS free, NULL::BIGINT AS slot
  UNION ALL
  SELECT t + 1, list_filter(free, lambda x: x <> c), c FROM (
    SELECT t, free, list_min(list_transform(free, lambda x: (q.a[t % {SHARDS} + 1] * x + q.b[t % {SHARDS} + 1]) % {SIZE} * {SIZE} + x)) % {SIZE} AS c
    FROM turns, q WHERE t < {SIZE}))
SELECT doc_id, slot AS shard_slot, ((t - 1) % {SHARDS})::INTEGER AS shard_id
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SIZE} AS s FROM documents)
JOIN turns ON slot = s
"""
