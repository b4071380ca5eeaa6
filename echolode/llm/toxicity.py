"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every word, every pair of neighbours and every pair with one or two words left out is hashed into
``2**bits`` binary features (present in the text or not). FTRL-proximal keeps a learning rate for
each coordinate and its L1 term leaves most weights at exactly zero, so a model is the indices and values of
the few weights that are left and is broadcast whole (at most ``2**bits`` floats, whatever the corpus).

The sample is learnt from in one task of an executor, which a lost executor makes run again; the driver gets the weights
that aren't zero, never a text or its features. Scores are a column of an Arrow function over the text alone, so
other columns, whatever their names, stay where they are.

Null and empty texts have the bias alone; bytes that are no UTF-8 are word characters. Repeated rows get equal scores;
of rows of one doc_id that differ, one is learnt from. Very long texts are read whole. Null labels and labels without a
document teach nothing; several labels of one document count as their largest. Without any label the score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, as_batch, documents, fold, hashed_share, map_rows, mix

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SKIPS = (1, 2, 3)


@dataclass(frozen=True)
class FtrlParams:
    """``sample_rows`` bounds the toxic rows that are learnt from, twice it the others: those of the smallest hashed ids.
    ``sample_bytes`` bounds what their feature numbers take in the task that learns; rows of larger hashes are left out beyond it."""

    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 15.0
    l2: float = 0.1
    epochs: int = 8
    sample_rows: int = 2500
    sample_bytes: int = 400_000_000
    threshold: float = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    index: np.ndarray  # positions of the weights that are not zero
    value: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float64)
        out[self.index] = self.value
        return out


def features(data: bytes | None, cache: WordHash, bits: int) -> np.ndarray:
    """Feature numbers of a text, in order and with repeats: words, then pairs at distance 1, 2 and 3."""
    words = cache.array(WORD.findall(data.lower())) if data else np.zeros(0, np.uint64)
    parts = [mix(words)] + [mix(mix(words[:-d] + np.uint64(d)) + words[d:]) for d in SKIPS if len(words) > d]
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


def ftrl(rows: Iterable[tuple[np.ndarray, int]], params: FtrlParams) -> ToxicityModel:
    """Learn from (distinct feature numbers, label) in the given order, ``epochs`` times."""
    rows = list(rows)  # read once an epoch
    z, n = np.zeros(1 + (1 << params.bits)), np.zeros(1 + (1 << params.bits))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * params.l1) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)
        return np.where(np.abs(z[at]) <= params.l1, 0.0, w)

    for _ in range(params.epochs):
        for at, label in rows:
            at = np.append(at, 1 << params.bits)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w[:-1])
    bias = float(w[-1]) if rows else -40.0
    return ToxicityModel(kept.astype(np.int32), w[kept], bias, params.bits)


def score_text(data: bytes | None, cache: WordHash, dense: np.ndarray, bias: float, bits: int) -> float:
    at = features(data, cache, bits)
    at = np.unique(at[dense[at] != 0])
    return float(1 / (1 + np.exp(-np.clip(dense[at].sum() + bias, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> ToxicityModel:
    """Fit on at most ``sample_rows`` toxic and twice as many other labelled documents outside fold 1 of 3."""
    told = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("y"))
    )
    n = {r["y"]: r["count"] for r in told.groupBy("y").count().collect()}  # two rows at most
    some = hashed_share(told.where("y = 1"), "doc_id", params.sample_rows, n.get(1, 0)).unionByName(hashed_share(told.where("y = 0"), "doc_id", 2 * params.sample_rows, n.get(0, 0)))

    def make():
        cache = WordHash()
        return lambda b: as_batch(
            doc_id=b["doc_id"],
            y=b["y"],
            at=pa.array([np.unique(features(x, cache, params.bits)).tobytes() for x in b["text"].to_pylist()], pa.binary()),
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for at, y in zip(b["at"], b["y"].to_pylist(), strict=True):
                if held < params.sample_bytes:
                    rows.append((np.frombuffer(at.as_py(), np.int32), y))
                    held += rows[-1][0].nbytes
        model = ftrl(rows, params)
        sampled = sum(y for _, y in rows)
        index, value = np.append(model.index, [-1, -2, -3]), np.append(model.value, [model.bias, len(rows) - sampled, sampled])
        yield as_batch(index=pa.array(index, pa.int32()), value=pa.array(value, pa.float64()))

    # the sample is bounded by a parameter, so it may be broadcast and learnt from in one task
    near = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id")
    rows = map_rows(near, make, "doc_id long, y int, at binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("at").alias("at"))
    alone = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "at")
    got = alone.mapInArrow(learn, "index int, value double").toArrow()
    index, value = got["index"].to_numpy(), got["value"].to_numpy()
    if not len(index):  # no partition at all: nothing was learnt
        return ftrl([], params)
    model = ToxicityModel(index[:-3], value[:-3], float(value[-3]), params.bits)
    # toxic rows are a larger share of the sample than of all labels: the bias is moved back by the log of the two odds
    if min(n.get(0, 0), n.get(1, 0), value[-2], value[-1]) > 0:
        model = replace(model, bias=model.bias + float(np.log(n[1] / n[0]) - np.log(value[-1] / value[-2])))
    return model


def scorer(spark: SparkSession, model: ToxicityModel) -> Callable[[Column], Column]:
    """A function of a text column that gives its score; the model is broadcast once."""
    told = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, cache = told.value, WordHash()
        dense = model.dense()
        for texts in batches:
            yield pa.array([score_text(x.as_py(), cache, dense, model.bias, model.bits) for x in texts], pa.float64())

    return lambda text: score(text.cast("binary"))


def query(spark: SparkSession, sf_dir: str, params: FtrlParams = FtrlParams()) -> DataFrame:
    """op1: doc_id, held_out, score, predicted for every document."""
    docs = documents(spark, sf_dir)
    score = scorer(spark, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), params))
    told = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score(F.col("text")).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go, others keep their columns (a null id is kept by its own score)."""
    score = scorer(spark, train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.where(score(F.col("text")) < FtrlParams.threshold)
