"""LM scoring by subword lattice likelihood.

The pieces and their first weights are those of an existing public vocabulary (its scores are merge ranks, taken
as a Zipf prior). One step of expectation maximisation over all training words, by their counts, re-weights the pieces; the vocabulary
itself stays as it is, and its own scores keep ``prior`` of all weight, whatever the size of the corpus. A word's probability is the sum over all of its segmentations, by a forward recursion
in log space; a text's, ``score``, is the product over its words and one end. Characters outside the vocabulary fall back to bytes.

``mixed_score`` is another model beside it: a word of the training rows is one more edge of its own lattice, from start to end, of weight
(c - discount) / N; the discounted mass is what the segmentations share, so that the probabilities of all words and the end sum to one at most.

Words are counted by a map-side Counter and one shuffle. The most frequent words (``frequent``: a bound; the count that they
have at least comes from a histogram of counts) are broadcast to the scoring pass, all others go through a shuffle join with
the word table. A null or empty text has its end only, a very long one is read whole, bytes that are no UTF-8 count as
U+FFFD. Repeated rows get one row each, also those without a doc_id. Ties don't matter. Without training rows counts are 0 and
N is 0; an empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_batch, documents, fold, map_rows, words_of

START = "▁"


@dataclass(frozen=True)
class LatticeParams:
    vocabulary: str | None = None  # a sentencepiece model; None: the public one installed here
    prior: float = 0.1  # share of the vocabulary's own scores in the weights
    discount: float = 0.75  # taken from the count of each training word and given to the segmentations
    frequent: int = 1 << 17  # words that are broadcast
    flush: int = 1_000_000  # words that a counting task holds


def vocabulary(path: str | None) -> tuple[dict[str, int], np.ndarray]:
    """Number of each piece and its prior probability; the last is the end. Bytes are pieces <0x00> to <0xFF>."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i), model.is_byte(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    weight = np.array([1 / 60_000 if byte else 1 / (10 - max(s, -1e6)) for _, s, byte in pieces] + [1e-2])
    return {p: k for k, (p, _, _) in enumerate(pieces)}, weight / weight.sum()


class Lattice:
    """Forward (and backward) recursion over the segmentations of one word."""

    def __init__(self, number: dict[str, int], p: np.ndarray) -> None:
        self.number, self.log = number, np.log(p).tolist()
        # every end of a piece is a key, so that a search that grows to the left can stop; those that are no piece have ()
        self.known = dict.fromkeys((s[a:] for s in number for a in range(len(s))), ())
        self.known |= {s: (self.log[k], k) for s, k in number.items()}
        self.longest = max(map(len, number))

    def byte_ids(self, c: str) -> list[int]:
        return [self.number[f"<0x{b:02X}>"] for b in c.encode()]

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, list[float], list[list[tuple]]]]:
        """For each word its forward log sums f and, for every end, the (start, log p, piece) that end there.

        Both depend on what stands before a place only, so what a word shares with the last one is not done again:
        give words in order."""
        known, log, exp, longest = self.known.get, math.log, math.exp, self.longest
        f, edges, last = [0.0], [], ""
        for word in words:
            s = START + word
            same = 0
            for x, y in zip(s, last, strict=False):
                if x != y:
                    break
                same += 1
            del f[same + 1 :], edges[same:]
            for end in range(same + 1, len(s) + 1):
                own = []
                for a in range(end - 1, end - longest - 1 if end > longest else -1, -1):
                    got = known(s[a:end])
                    if got:
                        own.append((a, got[0], got[1]))
                    elif got is None:
                        break
                if not known(s[end - 1]):
                    own.append((end - 1, sum(self.log[k] for k in self.byte_ids(s[end - 1])), -1))
                if len(own) == 1:
                    f.append(f[own[0][0]] + own[0][1])
                else:
                    terms = [f[a] + lp for a, lp, _ in own]
                    top = max(terms)
                    f.append(top + log(sum([exp(x - top) for x in terms])))
                edges.append(own)
            last = s
            yield s, f, edges

    def logp(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        order, out = sorted(range(len(words)), key=words.__getitem__), np.zeros(len(words))
        for k, (_, f, _) in zip(order, self.walk(words[k] for k in order), strict=True):
            out[k] = f[-1]
        return out

    def expect(self, counted: Iterable[tuple[str, int]], into: np.ndarray) -> None:
        """Add the expected uses of each piece in the counted words."""
        exp, counted = math.exp, sorted(counted)
        for (_, count), (s, f, edges) in zip(counted, self.walk(w for w, _ in counted), strict=True):
            b = [0.0] * len(f)  # what of the count passes each place
            b[-1] = count
            for end in range(len(s), 0, -1):
                if here := b[end]:
                    for a, lp, piece in edges[end - 1]:
                        share = here * exp(f[a] + lp - f[end])
                        b[a] += share
                        if piece >= 0:
                            into[piece] += share
                        else:
                            for k in self.byte_ids(s[a]):
                                into[k] += share


def count_words(docs: DataFrame, params: LatticeParams) -> DataFrame:
    """word, c (in training rows), total (in all rows)."""

    def run(batches):
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flushed():
            for held, c in counts.items():
                n = pa.array(c.values(), pa.int64())
                zero = pa.array(np.zeros(len(c), np.int64))
                yield as_batch(word=pa.array(c.keys(), pa.binary()).cast(pa.string()), c=zero if held else n, total=n)
                c.clear()

        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                for held, data in zip(part["held"].to_pylist(), part["text"].to_pylist(), strict=True):
                    counts[held].update(words_of(data))
                if len(counts[True]) + len(counts[False]) > params.flush:
                    yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, "word string, c long, total long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


@dataclass(frozen=True)
class LatticeModel:
    number: dict[str, int]
    p: np.ndarray
    tokens: int  # N
    distinct: int  # V
    ends: int


def fit(words: DataFrame, ends: int, params: LatticeParams) -> LatticeModel:
    """Re-weight the pieces by one EM step over all training words; what reaches the driver is one number a piece."""
    number, p = vocabulary(params.vocabulary)
    prior = words.sparkSession.sparkContext.broadcast((number, p))

    def run(batches):
        lattice, into = Lattice(*prior.value), [0.0] * len(p)
        for b in batches:
            lattice.expect(zip(b["word"].to_pylist(), b["c"].to_pylist(), strict=True), into)
        used = [k for k, x in enumerate(into) if x]
        yield as_batch(piece=pa.array(used, pa.int32()), uses=pa.array([into[k] for k in used], pa.float64()))

    trained = words.where("c > 0")
    uses = trained.select("word", "c").mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()
    n, v = trained.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    weight = np.zeros(len(p))
    weight[uses["piece"].to_numpy()] += uses["uses"].to_numpy()
    weight[-1] += ends
    seen = weight.sum()
    return LatticeModel(number, params.prior * p + (1 - params.prior) * weight / seen if seen else p, n + ends, v + (ends > 0), ends)


def score(spark: SparkSession, docs: DataFrame, params: LatticeParams = LatticeParams()) -> DataFrame:
    """doc_id, held, n_tokens, n_known, train_tokens, base_score, score, mixed_score of every row of doc_id, text, held.
    score is the marginal over the vocabulary's pieces alone, mixed_score has the edges of training words besides."""
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "held", F.make_valid_utf8("text").cast("binary").alias("text"))
    words = scratch.cut(count_words(docs, params), "counts")
    ends = docs.where(~F.col("held")).count()
    model = fit(words, ends, params)
    floor, told = float(model.tokens + model.distinct + 1), spark.sparkContext.broadcast(model)

    def make_word():
        model = told.value
        lattice = Lattice(model.number, model.p)
        share = math.log(max(params.discount * (model.distinct - 1), 1) / max(model.tokens, 1))  # at least one discount

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            c = b["c"].to_numpy()
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(c - params.discount, 0) / max(model.tokens, 1))
            lat = lattice.logp(b["word"].to_pylist())
            lp = np.logaddexp(own, share + lat) / math.log(10)
            base = np.log10((c + 1) / floor)
            return as_batch(word=b["word"], c=b["c"], total=b["total"], base=pa.array(base), lp=pa.array(lp), lat=pa.array(lat / math.log(10)))

        return work

    table = scratch.cut(map_rows(words, make_word, "word string, c long, total long, base double, lp double, lat double", rows=10_000), "words")
    scratch.drop("counts")
    # the words above a count are broadcast: the least count that no more than ``frequent`` words have, by eighths of an octave
    step = F.floor(F.log2(F.greatest("total", F.lit(1))) * 8).cast("int").alias("step")
    least, many = None, 0
    for r in table.groupBy(step).count().orderBy(F.desc("step")).collect():  # some hundreds of rows at most
        many += r["count"]
        if many > params.frequent:
            break
        least = r["step"]
    often = table.where(step >= least if least is not None else F.lit(False)).select(F.col("word").cast("binary").alias("word"), "c", "base", "lp", "lat").toArrow()
    frequent = spark.sparkContext.broadcast((often["word"].to_pylist(), np.stack([(often["c"].to_numpy() > 0) * 1.0, *(often[x].to_numpy() for x in ("base", "lp", "lat"))], axis=1)))
    end_base, end_lp = math.log10((ends + 1) / floor), math.log10(ends / model.tokens if ends else 0.5)
    end_lat = math.log10(model.p[-1])

    def make_doc():
        listed, values = frequent.value
        number = {w: k for k, w in enumerate(listed)}.get

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = defaultdict(list)
            for data in b["text"].to_pylist():
                words = words_of(data)
                at = np.array([number(w, -1) for w in words], np.int64)
                rest = Counter([words[k] for k in np.flatnonzero(at < 0)])
                at = at[at >= 0]
                sums = values[at].sum(axis=0) if len(at) else np.zeros(4)
                n, n_known, base, lp, lat = 1 + len(words), int(ends > 0) + int(sums[0]), end_base + float(sums[1]), end_lp + float(sums[2]), end_lat + float(sums[3])
                for name, x in (("n", n), ("n_known", n_known), ("base", base), ("lp", lp), ("lat", lat), ("rare", list(rest)), ("times", list(rest.values()))):
                    cols[name].append(x)
            kinds = {"n": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "lp": pa.float64(), "lat": pa.float64(), "rare": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}
            arrays = {k: pa.array(cols[k], t) for k, t in kinds.items()}
            arrays["rare"] = arrays["rare"].cast(pa.list_(pa.string()))
            return as_batch(doc_id=b["doc_id"], held=b["held"], **arrays)

        return work

    schema = "doc_id long, held boolean, n long, n_known long, base double, lp double, lat double, rare array<string>, times array<int>"
    # a row number within the partition's file order keeps repeated rows apart
    parts = scratch.cut(map_rows(docs, make_doc, schema).withColumn("row", F.monotonically_increasing_id()), "parts")
    rare = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    sums = (
        rare.join(table.select("word", "c", "base", "lp", "lat"), "word")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("k2"), F.sum(F.col("k") * F.col("base")).alias("b2"), F.sum(F.col("k") * F.col("lp")).alias("l2"), F.sum(F.col("k") * F.col("lat")).alias("m2"))
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return (
        parts.drop("rare", "times")
        .join(sums, "row", "left")
        .select("doc_id", "held", F.col("n").alias("n_tokens"), plus("n_known", "k2").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base", "b2").alias("base_score"), plus("lat", "m2").alias("score"), plus("lp", "l2").alias("mixed_score"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: scores of every document."""
    docs = documents(spark, sf_dir).withColumn("held", fold("doc_id", 7) == 2)
    return score(spark, docs).withColumnRenamed("held", "held_out")
