"""WARC fixity audit with Merkle trees.

Records lie in files by ranges of their id; within a file they are ordered and take byte ranges one after the other. A
leaf is the hash of one record with its id and length; a node is the hash of up to ``fan`` children in order, with the
byte range that they span, up to one root. Two replicas are compared from the root: a level's nodes are
looked at only below parents that differ, so agreeing branches are never read again. What is left are the records that
were altered, are missing, or are extra, with the byte range where the first replica has (or the second one put) them.

A level is an aggregation of at most ``fan`` rows a node and has a ``fan``-th of the rows of the one below. Null bodies
hash as the empty text, a null id is the last record of file -1, one record with id -1 if there is such an id. Equal rows of one id make one leaf with all of
them in order of their hash; ids that repeat differently in the replicas count as altered. Two empty replicas agree.
Very long bodies are hashed whole; columns other than the id and the body aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

FAN = 16
PER_FILE = FAN**3


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC response record, but for fields that differ between runs (date and record id)."""
    size = F.octet_length(body).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """k (global slot), hash, bytes of every record id; file k div PER_FILE, place k mod PER_FILE."""
    said = record(F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(body_col), F.lit("")))
    one = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k"), F.sha2(said.cast("binary"), 256).alias("one"), F.octet_length(said).cast("long").alias("bytes"))
    # rows of an id are summed up by the count of each hash first, then by the sorted list of distinct ones
    each = one.groupBy("k", "one", "bytes").agg(F.count("*").alias("n"))
    many = each.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("one", "n"))), lambda x: F.concat_ws("*", x["one"], x["n"].cast("string"))), ",").alias("all"), F.sum(F.col("bytes") * F.col("n")).alias("bytes"))
    return many.select("k", F.sha2(F.concat_ws(":", F.col("k").cast("string"), F.col("bytes").cast("string"), "all").cast("binary"), 256).alias("hash"), "bytes")


def parents(level: DataFrame) -> DataFrame:
    """The nodes above: k div FAN, the hash over the children's places, hashes and sizes in order, and the bytes they span."""
    child = F.transform(F.array_sort(F.collect_list(F.struct("k", "hash", "bytes"))), lambda x: F.concat_ws(":", x["k"].cast("string"), x["hash"], x["bytes"].cast("string")))
    return level.groupBy(F.floor(F.col("k") / FAN).cast("long").alias("up")).agg(F.sha2(F.array_join(child, ",").cast("binary"), 256).alias("hash"), F.sum("bytes").alias("bytes")).withColumnRenamed("up", "k")


def trees(scratch: Scratch, first: DataFrame, name: str, height: int) -> list[DataFrame]:
    out = [scratch.cut(first, f"{name}0")]
    for k in range(1, height + 1):
        out.append(scratch.cut(parents(out[-1]), f"{name}{k}"))
    return out


def audit(spark: SparkSession, first: DataFrame, second: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """k, status (altered, missing, extra), bytes and hashes of both, for all leaves that differ; ``first`` is the truth."""
    scratch = Scratch(spark)
    a0, b0 = (leaves(d, id_col, url_col, body_col) for d in (first, second))
    top = max([r[0] for r in (first.agg(F.max(id_col)).first(), second.agg(F.max(id_col)).first()) if r[0] is not None], default=0)
    height = 1
    while FAN**height <= max(top, 0):
        height += 1
    a, b = trees(scratch, a0, "a", height), trees(scratch, b0, "b", height)
    differ = None
    for k in range(height, -1, -1):
        x, y = (t.select("k", F.col("hash").alias(f"{s}_hash"), F.col("bytes").alias(f"{s}_bytes")) for t, s in ((a[k], "first"), (b[k], "second")))
        if differ is not None:
            x, y = (t.withColumn("up", F.floor(F.col("k") / FAN).cast("long")).join(differ, "up", "left_semi").drop("up") for t in (x, y))
        found = x.join(y, "k", "full").where(~F.col("first_hash").eqNullSafe(F.col("second_hash")))
        if k:
            differ = scratch.cut(found.select(F.col("k").alias("up")), f"d{k}")
    status = F.when(F.col("second_hash").isNull(), "missing").when(F.col("first_hash").isNull(), "extra").otherwise("altered")
    # byte offsets of both replicas, for the files that differ only: a running sum over one file of at most PER_FILE records
    files = scratch.cut(found.withColumn("status", status), "found")
    hit = files.select(F.floor(F.col("k") / PER_FILE).cast("long").alias("file")).distinct()

    def offsets(level: DataFrame, name: str) -> DataFrame:
        own = level.withColumn("file", F.floor(F.col("k") / PER_FILE).cast("long")).join(hit, "file", "left_semi")
        return own.select("k", (F.sum("bytes").over(W.partitionBy("file").orderBy("k")) - F.col("bytes")).alias(name))

    return reduce(lambda d, o: d.join(o, "k", "left"), (offsets(a[0], "first_offset"), offsets(b[0], "second_offset")), files)


def replica(pages: DataFrame) -> DataFrame:
    """The second replica of the query: the pages with faults put in by rule. Of every 97 ids one is altered in its
    first character, one is cut short by one, one is lost."""
    d = pages.select("page_id", "url", "html")
    html = F.when(F.expr("page_id % 97 = 11"), F.concat(F.lit("\u0001"), F.expr("substring(html, 2)"))).when(F.expr("page_id % 97 = 29"), F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return d.where(F.expr("page_id is null or page_id % 97 <> 53")).withColumn("html", html)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: where the second replica of ``pages`` differs from the first."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = audit(spark, pages, replica(pages))
    return found.select(
        F.when(F.col("k") >= 0, F.col("k")).alias("page_id"), F.floor(F.col("k") / PER_FILE).cast("long").alias("file_id"), "status", "first_offset", "first_bytes", "first_hash", "second_offset", "second_bytes", "second_hash"
    )


SQL = r"""
WITH r AS (
  SELECT 1 AS rep, page_id, url, html FROM pages
  UNION ALL
  SELECT 2, page_id, url, CASE WHEN page_id % 97 = 11 THEN chr(1) || substr(html, 2) WHEN page_id % 97 = 29 THEN substr(html, 1, length(html) - 1) ELSE html END
  FROM pages WHERE page_id IS NULL OR page_id % 97 <> 53),
w AS (SELECT rep, coalesce(page_id, -1) AS k, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
        || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
        || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS said FROM r),
e AS (SELECT rep, k, sha256(said) AS one, strlen(said)::BIGINT AS bytes, count(*) AS n FROM w GROUP BY ALL),
l AS (SELECT rep, k, string_agg(one || '*' || n, ',' ORDER BY one, n) AS al, sum(bytes * n)::BIGINT AS bytes FROM e GROUP BY rep, k),
h AS (SELECT rep, k, sha256(k || ':' || bytes || ':' || al) AS hash, bytes,
             (sum(bytes) OVER (PARTITION BY rep, floor(k / 4096.0) ORDER BY k) - bytes)::BIGINT AS off FROM l),
a AS (SELECT * FROM h WHERE rep = 1), b AS (SELECT * FROM h WHERE rep = 2)
SELECT CASE WHEN k >= 0 THEN k END AS page_id, floor(k / 4096.0)::BIGINT AS file_id,
       CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'altered' END AS status,
       a.off AS first_offset, a.bytes AS first_bytes, a.hash AS first_hash, b.off AS second_offset, b.bytes AS second_bytes, b.hash AS second_hash
FROM a FULL JOIN b USING (k) WHERE a.hash IS DISTINCT FROM b.hash
"""
