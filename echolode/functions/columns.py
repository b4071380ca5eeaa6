"""Column expressions: lines, tokens, overlap of sets, hashes, the hash embedding, intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a character that Python's str.strip() keeps
INK = r"[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: the line ends of Python's str.splitlines()
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def decoded(content: Column) -> Column:
    """Text of file bytes: malformed UTF-8 replaced, line ends as line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Like str.splitlines(): no empty line after the last line end."""
    return let(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII identifiers and numbers, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    ratio = let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(ratio)


def hash_vector(text: Column, dim: int = 16) -> Column:
    """The first bytes of the text's SHA-256 as numbers from 0 to 1, scaled to unit length."""
    raw = lambda digest: F.array(*[F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("double") / 255 for k in range(dim)])
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(F.sha2(text, 256), lambda d: let(raw(d), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n))))


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Lines that two closed ranges share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)


def covered(spans: Column) -> Column:
    """Lines in the union of closed ranges (array of struct s, e)."""
    start = F.struct(F.lit(-1).cast("int").alias("end"), F.lit(0).cast("int").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"] - 1, a["end"]))).cast("int").alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda a: a["n"])
