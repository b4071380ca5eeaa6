"""Quality: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes pass ``filters`` learnt filters of ``width`` bytes each; a filter is a table of weights by place and
byte. Over every chunk of two blocks of ``block`` places, the next one beginning one block later, the greatest answer of
each filter is kept (max-pooling), so chunks overlap and together cover the whole text. A dense layer makes
``hidden`` features of a chunk, and their maxima and means over all chunks give one probability by a logistic unit.

Learning is Adam over minibatches, by back-propagation, in one task of an executor, which a lost executor makes run again.
The sample is bounded by rows and by bytes, both parameters; the driver gets the weights alone (one size whatever the
corpus). Texts are scored in slices of a bounded number of places, so that a very long one takes no more memory than others.

Null and empty texts have one empty chunk, and so all of them one score; those shorter than a filter are followed by zero bytes. Repeated
rows get equal scores; of rows of one doc_id that differ, one is learnt from. Null labels and labels without a document
teach nothing; several labels of one document count as their largest. Ties don't occur: the sample is ordered by hash,
then id. A null doc_id is scored by its text, an empty table gives no rows, columns other than doc_id and text aren't
read. If no label or only one class was learnt from, the score is that class's share (0 without any label).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_batch, documents, fold, hashed_share


@dataclass(frozen=True)
class CnnParams:
    """``sample_rows`` bounds the rows of the rarer label that are learnt from, twice it those of the other one, and
    ``sample_bytes`` the texts of all of them together."""

    width: int = 6
    filters: int = 24
    hidden: int = 12
    block: int = 128
    epochs: int = 4
    batch: int = 32
    rate: float = 0.01
    sample_rows: int = 1500
    sample_bytes: int = 16 << 20
    threshold: float = 0.7


#: places that are looked at in one go, a multiple of the block
SLICE = 4096


@dataclass
class Network:
    """Weights: ``table`` (width, 256, filters) and its bias, the dense layer of chunks, the logistic unit."""

    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    last: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.dense, self.offset, self.out, self.last]


def fresh(p: CnnParams) -> Network:
    rng = np.random.default_rng(7)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(draw(p.width, 256, p.filters, scale=0.1), np.zeros(p.filters, np.float32), draw(p.filters, p.hidden, scale=p.filters**-0.5), np.full(p.hidden, 0.1, np.float32), draw(2 * p.hidden, scale=0.3), np.zeros(1, np.float32))


def blocks_of(data: bytes | None, net: Network, block: int, places: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's greatest answer in each block of places, and, if asked for, where it was."""
    width, filters = net.table.shape[0], net.table.shape[2]
    if not data:
        return np.zeros((0, filters), np.float32), None
    b = np.frombuffer(data + bytes(max(0, width - len(data))), np.uint8)
    n, best, where = len(b) - width + 1, [], []
    for start in range(0, n, SLICE):
        end = min(n, start + SLICE)
        s = net.table[0].take(b[start:end], axis=0)
        for k in range(1, width):
            s += net.table[k].take(b[start + k : end + k], axis=0)
        whole = len(s) // block * block
        for first, part in ((0, s[:whole].reshape(-1, block, filters)), (whole, s[None, whole:])):
            if not part.size:
                continue
            if places:
                at = part.argmax(axis=1)
                best.append(np.take_along_axis(part, at[:, None], axis=1)[:, 0])
                where.append(at + (start + first + block * np.arange(len(part)))[:, None])
            else:
                best.append(part.max(axis=1))
    return np.concatenate(best), np.concatenate(where) if places else None


def chunks(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk, that is two neighbouring blocks (the only one, if there is one), the greatest answers and which block had them."""
    if len(best) < 2:
        return best, np.zeros(best.shape, np.int64)
    later = best[1:] > best[:-1]
    return np.where(later, best[1:], best[:-1]), later + np.arange(len(later))[:, None]


def forward(best: np.ndarray, net: Network) -> tuple[float, tuple]:
    top, block = chunks(best)
    x = np.maximum(top + net.bias, 0) if len(top) else np.zeros((1, len(net.bias)), np.float32)
    h = np.maximum(x @ net.dense + net.offset, 0)
    most = h.argmax(axis=0)
    z = np.concatenate([h[most, np.arange(h.shape[1])], h.mean(axis=0)])
    return float(z @ net.out + net.last[0]), (block, x, h, most, z)


def probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def score_text(data: bytes | None, net: Network, block: int) -> float:
    return probability(forward(blocks_of(data, net, block, False)[0], net)[0])


def backward(data: bytes | None, label: int, net: Network, block: int, grads: list[np.ndarray]) -> None:
    """Adds the gradients of one text's log loss."""
    best, where = blocks_of(data, net, block, True)
    logit, (chosen, x, h, most, z) = forward(best, net)
    g = np.float32(probability(logit) - label)
    dz, hidden = g * net.out, h.shape[1]
    grads[4] += g * z
    grads[5] += g
    dh = np.repeat(dz[None, hidden:] / len(h), len(h), axis=0)
    dh[most, np.arange(hidden)] += dz[:hidden]
    dh *= h > 0
    grads[2] += x.T @ dh
    grads[3] += dh.sum(axis=0)
    dx = (dh @ net.dense.T) * (x > 0)
    if not len(best):
        return
    grads[1] += dx.sum(axis=0)
    i, f = np.nonzero(dx)
    at, b = where[chosen[i, f], f], np.frombuffer(data + bytes(net.table.shape[0]), np.uint8)
    for k in range(net.table.shape[0]):
        np.add.at(grads[0][k], (b[at + k], f), dx[i, f])


def learn(rows: list[tuple[bytes | None, int]], p: CnnParams) -> Network:
    """Adam over minibatches of (bytes, label), in orders that follow from the rows' own."""
    net, rng, t = fresh(p), np.random.default_rng(7), 0
    first, second = ([np.zeros_like(w) for w in net.parts()] for _ in range(2))
    for epoch in range(p.epochs):
        rate = p.rate * (1 - epoch / p.epochs)
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // p.batch)):
            grads, t = [np.zeros_like(w) for w in net.parts()], t + 1
            for k in at:
                backward(*rows[k], net, p.block, grads)
            for w, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                g /= len(at)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return net


def train(docs: DataFrame, labels: DataFrame, p: CnnParams = CnnParams()) -> Network:
    """Fit on a bounded sample of labelled documents outside fold 2 of 4, of the smallest hashed ids."""
    told = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in told.groupBy("y").count().collect()}  # two rows at most
    rare = min((0, 1), key=lambda y: n.get(y, 0))
    some = hashed_share(told.where(F.col("y") == rare), "doc_id", p.sample_rows, n.get(rare, 0)).unionByName(hashed_share(told.where(F.col("y") != rare), "doc_id", 2 * p.sample_rows, n.get(1 - rare, 0)))
    # the sample is bounded by a parameter, so it may be broadcast; lengths come first, and texts only of rows within the bound
    near = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id")
    sizes = near.groupBy("doc_id").agg(F.coalesce(F.max(F.octet_length("text")), F.lit(0)).cast("long").alias("size"))
    sum_so_far = F.sum("size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most 3 * sample_rows rows of two numbers
    fits = sizes.withColumn("so_far", sum_so_far).where(F.col("so_far") <= p.sample_bytes).select("doc_id")
    rows = near.join(F.broadcast(fits), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    alone = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x, y) for b in batches for x, y in zip(b["text"].to_pylist(), b["y"].to_pylist(), strict=True)]
        ones = sum(y for _, y in rows)
        if 0 < ones < len(rows):
            net = learn(rows, p)
            # the rarer label is a larger share of the sample than of all labels: the bias is moved by the log of the two odds
            net.last += np.float32(np.log(n[1] / n[0]) - np.log(ones / (len(rows) - ones)))
        else:
            net = constant(35.0 if ones else -35.0, p)
        yield as_batch(weights=pa.array([w.astype("<f4").tobytes() for w in net.parts()], pa.binary()))

    got = alone.mapInArrow(run, "weights binary").toArrow()["weights"].to_pylist()
    if not got:  # no partition at all: nothing was learnt
        return constant(-35.0, p)
    return Network(*(np.frombuffer(x, "<f4").reshape(w.shape) for x, w in zip(got, fresh(p).parts(), strict=True)))


def constant(logit: float, p: CnnParams) -> Network:
    net = Network(*(np.zeros_like(w) for w in fresh(p).parts()))
    net.last += np.float32(logit)
    return net


def scorer(spark: SparkSession, net: Network, p: CnnParams = CnnParams()) -> Callable[[Column], Column]:
    """A function of a text column that gives its probability; the weights are broadcast once (a fixed size)."""
    told = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([score_text(x.as_py(), told.value, p.block) for x in texts], pa.float64())

    return lambda text: score(text.cast("binary"))


def query(spark: SparkSession, sf_dir: str, p: CnnParams = CnnParams()) -> DataFrame:
    """op13: doc_id, held_out, score, predicted for every document."""
    docs = documents(spark, sf_dir)
    score = scorer(spark, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), p), p)
    told = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), score(F.col("text")).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
