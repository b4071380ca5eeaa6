"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document; its failure is one bit of ``fail_bits`` and what it measured stays beside
it. A policy is a named, versioned mask of rules: applying one, or asking what each rule of it drops alone, reads the
ledger only. Built-in functions throughout; a document's windows stay within its row, so nothing is shuffled.

A null text has no words, as an empty one. Ties don't occur. Repeated rows get equal rows. Very long texts are
measured whole; their repeated windows are found by a sort within the row. A null doc_id is kept, an
empty table gives no rows, and columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BLANKS = r"[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"

#: rule -> SQL condition of failure over the measurements; the place in this list is the bit. Append only.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 3 and 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
}

#: policy -> its rules. A published policy never changes; a new one gets a new name.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "short_words"],
}


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.expr(f"filter(split(text, '{BLANKS}'), x -> x <> '')").alias("w"))
    # windows of three words by 64-bit hash, and the sorted hashes
    d = d.select("doc_id", "text", "w", F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))").alias("h"))
    d = d.select("doc_id", "text", "w", "h", F.sort_array("h").alias("s"))
    d = d.select("doc_id", "text", "w", "h", F.expr("if(size(s) < 2, cast(array() as array<bigint>), array_distinct(filter(s, (x, j) -> j > 0 and x = get(s, j - 1))))").alias("twice"))
    # where windows found twice start: by a look into the few hashes, or by one sort of (hash, place) if they are many
    few = "filter(sequence(0, size(h) - 1), i -> array_contains(twice, get(h, i)))"
    d = d.withColumn("p", F.expr("if(size(twice) <= 48, null, sort_array(transform(h, (x, i) -> struct(x as x, i as i))))"))
    many = "sort_array(transform(filter(p, (q, j) -> (j > 0 and q.x = get(p, j - 1).x) or (j < size(p) - 1 and q.x = get(p, j + 1).x)), q -> q.i))"
    starts = f"case when size(twice) = 0 then cast(array() as array<int>) when size(twice) <= 48 then {few} else {many} end"
    covered = f"aggregate({starts}, struct(-3 as last, 0L as n), (a, i) -> struct(i as last, a.n + least(3, i - a.last) as n), a -> a.n)"
    lines = r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    d = d.select("doc_id", "text", F.size("w").cast("long").alias("n_words"), F.expr("length(array_join(w, ''))").cast("long").alias("word_chars"), F.expr(covered).alias("n_repeat_words"), F.expr(lines).alias("l"))
    d = d.select(
        "doc_id",
        "n_words",
        "word_chars",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.expr("size(l) - size(array_distinct(l))").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("l").cast("long").alias("n_lines"),
    )
    bits = F.lit(0)
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), 1 << k).otherwise(0))
    return d.withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether the ledger's row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def alone(policy: str) -> Column:
    """The bit of the one rule without which the policy would keep the row, 0 where there is no such rule."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    return F.when(F.bit_count(bits) == 1, bits).otherwise(0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """rule, failed (rows that fail it), alone (rows that only it drops), for each rule of a policy, and all bits that
    were ever set; one pass with partial aggregation."""
    own = [(r, 1 << list(RULES).index(r)) for r in POLICIES[policy]]
    hit = lambda bit: F.col("fail_bits").bitwiseAND(F.lit(bit))
    sums = [x for r, bit in own for x in (F.count_if(hit(bit) != 0).alias(f"failed_{r}"), F.count_if(alone(policy) == bit).alias(f"alone_{r}"))]
    one = rows.agg(F.coalesce(F.bit_or("fail_bits"), F.lit(0)).alias("ever"), *sums)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"failed_{r}").alias("failed"), F.col(f"alone_{r}").alias("alone"), (F.col("ever").bitwiseAND(F.lit(bit)) != 0).alias("ever")) for r, bit in own])
    return one.select(F.inline(each))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the ledger of every document under the newest policy, with the bit of the rule that alone drops it."""
    rows = ledger(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "fail_bits", alone("v1").alias("alone_bit"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines
      FROM t LEFT JOIN cov USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
             | (CASE WHEN n_dup_lines > 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
             | (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) | (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) AS fail_bits
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits::INTEGER AS fail_bits,
       CASE WHEN bit_count(fail_bits) = 1 THEN fail_bits ELSE 0 END::INTEGER AS alone_bit FROM b
"""
