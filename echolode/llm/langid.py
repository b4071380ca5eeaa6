"""Language identification by hierarchical discrimination.

The first level votes on the language family, the second on the languages of that family; each vote is a linear
support vector machine that tells two classes apart (one versus one). Features are hashed byte pairs and triples of
the lower-cased text, digits and punctuation taken as blanks, scaled to unit length.

Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing could be learnt. Repeated
rows get equal predictions and teach once; ties go to the language that comes first in the alphabet. Very long texts are
read whole, bytes that are no UTF-8 count as U+FFFD, a null doc_id is kept, an empty table gives no rows, and
columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, fold, map_rows

def lettered(text: str) -> bool:
    """Whether the text has a letter (general category L)."""
    return any(map(str.isalpha, text))


# Language families by ISO 639-1 code. A code that is in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tk tt uz",
    "indic": "bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


@dataclass(frozen=True)
class LangParams:
    """``per_language`` bounds (in expectation) the labelled documents of each language that are learnt from, ``rows`` those
    of all languages together, which share it evenly. ``lam`` weighs the L2 term of a machine's loss."""

    bits: int = 11
    per_language: int = 1500
    rows: int = 6000
    epochs: int = 12
    lam: float = 0.1


BLANK = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(text: str, bits: int) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode().translate(BLANK) + b" ", np.uint8).astype(np.uint32)
    pairs = (b[:-1] << np.uint32(8)) | b[1:]
    both = np.concatenate([pairs, (pairs[:-1] << np.uint32(8)) | b[2:] | np.uint32(1 << 24)])
    x = np.bincount((both * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits).astype(np.float32)
    x = np.sqrt(x)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, params: LangParams) -> np.ndarray:
    """Weights and bias of the hinge loss with L2, by averaged stochastic subgradients in a fixed order."""
    rng, w = np.random.default_rng(7), np.zeros(x.shape[1] + 1)
    mean, t = np.zeros_like(w), 0
    for epoch in range(params.epochs):
        order = rng.permutation(len(y))
        for at in np.array_split(order, max(1, len(y) // 32)):
            t += 1
            wrong = at[y[at] * (x[at] @ w[:-1] + w[-1]) < 1]
            rate = 1 / (params.lam * (t + 10))
            w *= 1 - rate * params.lam
            w[:-1] += rate / max(1, len(at)) * (y[wrong] @ x[wrong])
            w[-1] += rate / max(1, len(at)) * y[wrong].sum()
            if epoch >= params.epochs // 2:
                mean += w
    return mean / max(1, np.abs(mean).max())


@dataclass(frozen=True)
class LangModel:
    """pairs: for two classes their machine (above 0: the first), by level; the first level is named ''."""

    levels: dict[str, tuple[list[str], dict[tuple[str, str], np.ndarray]]]
    bits: int

    def vote(self, level: str, x: np.ndarray) -> tuple[str, float]:
        names, pairs = self.levels[level]
        if len(names) == 1:
            return names[0], 1.0
        got, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 9e9)
        for (a, b), w in pairs.items():
            m = float(x @ w[:-1] + w[-1])
            one = a if m >= 0 else b
            got[one] += 1
            least[one] = min(least[one], abs(m))
        best = max(names, key=lambda n: (got[n], least[n]))
        return best, 1 / (1 + float(np.exp(-min(20.0, 20 * least[best]))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.levels or not lettered(text):
            return "und", 0.0
        x = features(text, self.bits)
        family, p = self.vote("", x)
        lang, q = self.vote(family, x)
        return lang, p * q


def fit(x: np.ndarray, langs: list[str], params: LangParams) -> LangModel:
    by, names = defaultdict(list), np.array(langs, object)
    for lang in sorted(set(langs)):
        by[family_of(lang)].append(lang)

    def level(groups: dict[str, list[str]]):
        pairs, keys = {}, sorted(groups)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                y = np.where(np.isin(names, groups[a]), 1.0, np.where(np.isin(names, groups[b]), -1.0, 0.0))
                pairs[a, b] = svm(x[y != 0], y[y != 0], params)
        return keys, pairs

    if not langs:
        return LangModel({}, params.bits)
    return LangModel({"": level(by)} | {f: level({x: [x] for x in own}) for f, own in by.items()}, params.bits)


def train(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """Fit on text and non-null lang of documents outside fold 1 of 3, in one task of an executor, which gets at most
    twice ``params.rows`` rows of 2**bits numbers."""
    told = docs.withColumn("text", F.make_valid_utf8("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 3) != 1)).select("lang", "text", "doc_id")
    counts = {r["lang"]: r["count"] for r in told.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return fit(np.zeros((0, 1 << params.bits), np.float32), [], params)
    each = max(1, min(params.per_language, params.rows // len(counts)))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, each / n) * 1_000_000))])
    most = 2 * each * len(counts)
    hashed = F.xxhash64("text", "doc_id")
    # repeated rows teach once; if there are more rows than expected, those of the least hashes are taken
    some = told.where(F.pmod(hashed, F.lit(1_000_000)) < share[F.col("lang")]).dropDuplicates(["lang", "doc_id", "text"]).orderBy(hashed, "lang").limit(most)
    bits = params.bits

    def make():
        return lambda b: as_batch(
            lang=b["lang"], doc_id=b["doc_id"], x=pa.array([features(t, bits).tobytes() if lettered(t) else None for t in b["text"].to_pylist()], pa.binary())
        )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(lang, x) for b in batches for lang, x in zip(b["lang"].to_pylist(), b["x"].to_pylist(), strict=True)]
        x = np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(-1, 1 << bits)
        yield as_batch(model=pa.array([pickle.dumps(fit(x, [lang for lang, _ in got], params))], pa.binary()))

    rows = map_rows(some, make, "lang string, doc_id long, x binary").where("x is not null")
    told = rows.repartition(1).sortWithinPartitions("lang", "doc_id", "x").select("lang", "x").mapInArrow(learn, "model binary").toArrow()
    return pickle.loads(told["model"][0].as_py()) if len(told) else fit(np.zeros((0, 1 << bits), np.float32), [], params)


def predict(spark: SparkSession, docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    told = spark.sparkContext.broadcast(model)  # a machine has 2**bits weights; there is one for each two classes

    def make():
        model = told.value

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [model.predict(t) for t in b["text"].to_pylist()]
            return as_batch(doc_id=b["doc_id"], lang_pred=pa.array([x for x, _ in out], pa.string()), score=pa.array([p for _, p in out], pa.float64()))

        return work

    return map_rows(docs.select("doc_id", F.make_valid_utf8("text").alias("text")), make, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, held_out, lang_pred, score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(spark, docs, train(docs)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
