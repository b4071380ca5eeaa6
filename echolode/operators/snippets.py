"""Units (functions, whole texts) and the snippets cut from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..config import Windows
from ..functions import columns as C
from ..functions import cut, syntax

UNIT = "path string, language string, qualified_name string, start_line int, end_line int, code string, fn_ord int"


#: characters of windows that leave a task in one batch
OUT_CHARS = 4 << 20


def _identified(units: DataFrame) -> DataFrame:
    return units.withColumn("code_hash", F.sha2("code", 256)).withColumn("fn_id", F.concat_ws(":", "path", "qualified_name", F.col("start_line").cast("string"), F.col("end_line").cast("string")))


def function_units(files: DataFrame) -> DataFrame:
    """Functions of the Python files (path, content, language); a file that doesn't parse has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, "python", *f, k) for p, text in zip(part["path"], part["content"], strict=True) for k, f in enumerate(syntax.functions(text or ""))]
            out = pd.DataFrame(rows, columns=["path", "language", "qualified_name", "start_line", "end_line", "code", "fn_ord"])
            yield out

    return _identified(files.where("language = 'python'").select("path", "content").mapInPandas(run, UNIT))


@F.arrow_udf(IntegerType())
def _line_count(text: pa.Array) -> pa.Array:
    return pa.array([len((x.as_py() or "").splitlines()) for x in text], pa.int32())


@F.arrow_udf(ArrayType(StringType()))
def tokens(text: pa.Array) -> pa.Array:
    """As columns.tokens, which takes ten times as long on whole tables."""
    return pa.array([syntax.tokens(x.as_py()) if x.is_valid else None for x in text], pa.list_(pa.binary())).cast(pa.list_(pa.string()))


def text_units(files: DataFrame) -> DataFrame:
    """One unit for each text file that isn't blank: its base name and all of its lines."""
    told = files.where((F.col("language") == "text") & F.col("content").rlike(C.INK))
    return _identified(told.select("path", "language", F.element_at(F.split("path", "/"), -1).alias("qualified_name"), F.lit(1).alias("start_line"), _line_count("content").alias("end_line"), F.col("content").alias("code"), F.lit(0).alias("fn_ord")))


@F.udf(StringType(), useArrow=True)
def _normalised(text: str) -> str:
    return syntax.normalised(text or "")


OUT = ("kind", "fn_id", "path", "fn_start", "fn_end", "start_line", "end_line", "text", "snippet_hash")


def function_snippets(units: DataFrame, normalise: bool = True) -> DataFrame:
    """FUNC: one for each function."""
    text = _normalised("code") if normalise else F.col("code")
    key = F.concat_ws(":", F.lit("FUNC"), "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "code_hash")
    return units.select(F.lit("FUNC").alias("kind"), "fn_id", "path", F.col("start_line").alias("fn_start"), F.col("end_line").alias("fn_end"), "start_line", "end_line", text.alias("text"), F.sha2(key, 256).alias("snippet_hash"))


def window_snippets(units: DataFrame, params: Windows = Windows(), normalise: bool = True) -> DataFrame:
    """WIN: sliding windows of lines, short ones at the end too, with enough lines that aren't blank."""
    if params.stride_lines <= 0 or params.window_lines <= 0:
        raise ValueError("window and stride must be positive")

    kept = ("fn_id", "path", "start_line", "end_line", "code_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            row, at, rel, raw = zip(*found, strict=True) if found else ((),) * 4
            own = [b[c].take(pa.array(row, pa.int64())) for c in kept]
            return pa.RecordBatch.from_arrays([*own, pa.array(at, pa.int32()), pa.array(rel, pa.int32()), pa.array(raw, pa.string())], names=[*kept, "at", "rel", "raw"])

        for b in batches:
            found, size = [], 0
            for k, code in enumerate(b["code"]):
                for at, rel, raw in syntax.windows(code.as_py() or "", params.window_lines, params.stride_lines, params.min_nonempty):
                    found.append((k, at, rel, raw))
                    size += len(raw)
                    if size > OUT_CHARS:
                        yield told(b, found)
                        found, size = [], 0
            yield told(b, found)

    d = units.select(*kept, "code").mapInArrow(run, "fn_id string, path string, start_line int, end_line int, code_hash string, at int, rel int, raw string")
    d = d.withColumn("text", _normalised("raw") if normalise else F.col("raw"))
    key = F.concat_ws(":", F.lit("WIN"), "path", F.col("start_line").cast("string"), F.col("end_line").cast("string"), "code_hash", (F.col("at") + 1).cast("string"), F.col("rel").cast("string"), "text")
    return d.select(F.lit("WIN").alias("kind"), "fn_id", "path", F.col("start_line").alias("fn_start"), F.col("end_line").alias("fn_end"), (F.col("start_line") + F.col("at")).alias("start_line"), (F.col("start_line") + F.col("rel") - 1).alias("end_line"), "text", F.sha2(key, 256).alias("snippet_hash"))


#: what is told of a window without its text: sha256 of the text, its token set as a digest of hashes of 64 bits, and as hashes of 32
TOLD = "kind string, fn_id string, path string, fn_start int, fn_end int, start_line int, end_line int, snippet_hash string, digest binary, set binary, codes binary"


def told_windows(files: DataFrame, params: Windows = Windows()) -> DataFrame:
    """The windows of window_snippets(text_units(files)), as they are, by TOLD: texts are cut, hashed and read for tokens in one pass."""
    if params.stride_lines <= 0 or params.window_lines <= 0:
        raise ValueError("window and stride must be positive")
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in map(str.split, TOLD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end in cut.parts(b["content"]):
                part = b.slice(at, end - at)
                yield from cut.told(part["path"].to_pylist(), part["content"].cast(pa.binary()).to_pylist(), params.window_lines, params.stride_lines, params.min_nonempty, schema)

    return files.where("language = 'text'").select("path", "content").mapInArrow(run, TOLD)


def digest_vectors(told: pa.RecordBatch) -> pa.Array:
    """columns.hash_vector of texts, by their sha256."""
    raw = np.frombuffer(b"".join(x[:16] for x in told["digest"].to_pylist()), np.uint8).reshape(told.num_rows, 16) / 255.0
    norm = np.sqrt(np.cumsum(raw * raw, axis=1)[:, -1:])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * told.num_rows + 1, 16, dtype=np.int32)), pa.array((raw / norm).ravel()))
