"""Vectors for snippets: the hash embedder, a transformer if its library is there, and a cache of versions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Embedder
from ..functions.columns import hash_vector
from .scratch import Scratch
from .snapshots import Store


def cache_key(text: str, e: Embedder):
    return F.sha2(F.concat_ws(":", F.lit(e.model_name), F.lit(e.revision), F.lit(str(e.max_length)), F.sha2(text, 256)), 256)


def resolve_device(wanted: str, torch) -> str:
    if wanted != "auto":
        return wanted
    if getattr(torch.backends, "mps", None) and torch.backends.mps.is_available():
        return "mps"
    return "cuda" if torch.cuda.is_available() else "cpu"


def _transformer(texts: DataFrame, e: Embedder) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import torch
        from transformers import AutoModel, AutoTokenizer

        device = resolve_device(e.device, torch)
        tokenizer = AutoTokenizer.from_pretrained(e.model_name, revision=e.revision, trust_remote_code=e.trust_remote_code)
        load = lambda at: AutoModel.from_pretrained(e.model_name, revision=e.revision, trust_remote_code=e.trust_remote_code).to(at)
        try:
            model = load(device)
        except RuntimeError:  # a device without room or drivers; the processor is left
            if device == "cpu":
                raise
            model = load(device := "cpu")
        model.eval()
        for part in parts:
            vecs = []
            for k in range(0, len(part), e.batch_size):
                x = tokenizer(list(part["text"][k : k + e.batch_size]), padding=True, truncation=True, max_length=e.max_length, return_tensors="pt").to(device)
                with torch.no_grad():
                    h = model(**x).last_hidden_state
                m = x["attention_mask"].unsqueeze(-1)
                vecs += ((h * m).sum(1) / m.sum(1).clamp(min=1)).cpu().double().tolist()
            yield part.assign(vec=vecs)[["key", "text", "vec"]]

    return texts.mapInPandas(run, "key string, text string, vec array<double>")


VECTORS = "key string, vec array<double>"
#: of a cache's folder; one that was laid out in another way is moved aside, not read
LAYOUT = 2


def cache_store(spark: SparkSession, folder: str) -> Store:
    """The cache in a folder, ``~`` being the home folder; one of another layout is put aside under a name of its own."""
    store = Store(spark, f"{folder}/embeddings")
    found = store.current()
    if found.version and found.note.get("layout") != LAYOUT:
        store.aside(f"v{found.note.get('layout', 0)}")
    return store


def legacy(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """key, vec of the wanted keys that have a JSON file of their own, as older caches wrote them: {"vector": [...], "dim": n}, named
    by the key with ``_`` for each ``/``. Files that aren't that, or can't be parsed, count as missing."""
    try:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder if "://" in folder else os.path.abspath(os.path.expanduser(folder))).select("path", "content")
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], VECTORS)
    said = F.from_json(F.col("content").cast("string"), "vector array<double>, dim int")
    found = raw.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("name"), said.alias("said")).where("said.vector is not null and said.dim is not null and not exists(said.vector, x -> x is null)")
    return keys.withColumn("name", F.replace("key", F.lit("/"), F.lit("_"))).join(found, "name").select("key", F.col("said.vector").alias("vec"))


def embed(snippets: DataFrame, e: Embedder, cache: str = "") -> tuple[DataFrame, DataFrame]:
    """``snippets`` with vec and cached, and one row of cache_hits and cache_misses (by snippet). Equal texts are embedded once.
    With a cache folder only texts that it lacks are; these, and what older caches had as JSON files, become its next version."""
    keyed = snippets.withColumn("key", cache_key("text", e))
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    make = (lambda t: t.withColumn("vec", hash_vector(F.col("text")))) if e.name == "stub" else (lambda t: _transformer(t, e))
    counts = [F.count_if("cached").alias("cache_hits"), F.count_if(~F.col("cached")).alias("cache_misses")]
    if not cache:
        done = keyed.join(make(texts).select("key", "vec"), "key").drop("key").withColumn("cached", F.lit(False))
        return done, keyed.select(F.lit(False).alias("cached")).agg(*counts)
    spark = snippets.sparkSession
    scratch, store = Scratch(spark), cache_store(spark, cache)
    at = store.current()
    known = store.latest("vectors", VECTORS, "key", at)
    hits = scratch.cut(texts.join(known, "key").select("key", "vec"), "hits")
    missed = scratch.cut(texts.join(hits.select("key"), "key", "left_anti"), "missed")
    moved = scratch.cut(legacy(spark, cache, missed.select("key")), "moved")
    made = scratch.cut(make(missed.join(moved.select("key"), "key", "left_anti")).select("key", "vec"), "made")
    if not (moved.isEmpty() and made.isEmpty()):
        store.upsert("vectors", moved.unionByName(made), VECTORS, "key", {"layout": LAYOUT})
    vectors = hits.unionByName(moved).withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False)))
    done = keyed.join(vectors, "key").drop("key")
    return done, done.agg(*counts)
