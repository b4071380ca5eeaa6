"""What the operators of this folder share: input columns, folds, shared scratch tables, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]

#: White space of the word rule: space and the five ASCII controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the whole documents table; other columns are not read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, mod ``modulus``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, rows: int = 2000, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with state for each task: ``make`` runs once a task and returns the function of up to ``rows`` rows;
    ``done`` runs when the task's rows are through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield work(batch.slice(start, rows))
        if done:
            done()

    return df.mapInArrow(run, schema)


def as_batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def words_of(data: bytes | None) -> list[bytes]:
    """Words of the common rule over UTF-8: A-Z lower-cased, split at SPACE. bytes methods do exactly this."""
    return data.lower().split() if data else []


class WordHash(dict):
    """64-bit hash of a word, remembered for the task up to ``most`` words."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (multiply and shift, twice)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n-word window, in order; one hash of the whole sequence if there are fewer words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return h


def hashed_share(df: DataFrame, id_col: str, n: int, count: int) -> DataFrame:
    """At most ``n`` of the ``count`` rows, those of the smallest hashed ids: the same for any partitioning. Rows over the
    hash that about ``n`` lie below go first, so that what is sorted doesn't grow with partitions."""
    h = F.xxhash64(id_col)
    if count > 2 * n:
        df = df.where(h < F.lit(int((1.2 * n / count - 0.5) * 2**64)))
    return df.orderBy(h, id_col).limit(n)
