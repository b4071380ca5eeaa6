"""Packing as a cutting-stock problem solved by column generation.

Documents are token streams (ids and one end id). Whole sequences are cut off a stream as long as it fills them; what is
left is an item. Items are counted by length class (``grain`` tokens wide). The driver gets that histogram only (at most
``length / grain`` numbers), solves the linear program over patterns by column generation, where an unbounded knapsack
dynamic program prices new patterns, rounds the pattern counts down and packs the few items that are left best-fit
decreasing. Every item then finds its sequence from its rank within its class: ranks are row numbers within hashed
buckets plus the counts of the buckets before, so a length that a third of all documents share is spread like any other.

Null and empty texts have the end id alone. Repeated rows are packed each on its own, in any order among themselves. Very
long texts give many pieces. Bytes that are no UTF-8 count as U+FFFD. An empty table gives no rows. Columns other than
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, as_batch, documents, map_rows


@dataclass(frozen=True)
class PackParams:
    length: int = 4096
    grain: int = 8
    end_id: int = 2
    vocabulary: str | None = None  # a tokenizers file; None: the public one installed here
    rounds: int = 2000  # patterns that may be generated
    gap: float = 0.001  # stop when the program's value is this near its bound
    per_bucket: int = 100_000  # pieces in a bucket of the ranking, about


#: How the vocabulary file must split texts for chunks to be encoded apart from one another.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


#: Lower-case letters that no normal form changes when they stand together (a part of them, blanks allowed): each run is
#: one token group.
PLAIN = re.compile("[a-zß-öø-ÿα-ωа-џ ]*")

#: ASCII signs but the apostrophe's contractions: behind a letter, a chunk's last run of these is a token group of its own.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder(dict):
    """Ids of a chunk of text, as little-endian bytes. No token spans a blank or a line feed, case doesn't matter and
    signs that end a chunk after a letter are tokens of their own, so chunks are encoded apart from one another,
    lower-cased, without such an end, and remembered for the task, up to ``most`` of them. A batch's chunks are told
    apart and put together again as Arrow arrays; only those that differ are Python objects. That holds for files that
    split texts as SPLITS says; with any other file, and where a special token may stand in a text, it is encoded whole."""

    most = 400_000

    def __init__(self, path: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            told = json.load(f)
        self.added = [t["content"].encode().lower() for t in told.get("added_tokens") or ()]
        self.chunked = all(told.get(k) == v for k, v in SPLITS.items()) and not told.get("post_processor")
        self.joint = self.ids([";"])[0] if self.chunked else b""
        # for plain letters: the same model without normal forms and the pattern, and which ids end a token group
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)]
        )
        vocabulary, last = self.tokenizer.get_vocab(), told["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if last and t.endswith(last)]] = True

    def ids(self, texts: list[str], tokenizer=None) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, chunks: list[tuple[bytes, str]], sep: str, tokenizer, starts) -> list[tuple[bytes, str]]:
        """Encode chunks many in a call, ``sep`` between them; ``starts`` tells where each one's ids start and end. Those
        of a call that comes apart otherwise than it was put together are returned."""
        left = []
        for k in range(0, len(chunks), 2000):
            part = chunks[k : k + 2000]
            got = self.ids([sep.join([text for _, text in part])], tokenizer)[0]
            firsts, lasts = starts(np.frombuffer(got, "<u4"))
            if len(firsts) == len(part):
                self.update((w, got[a:b]) for (w, _), a, b in zip(part, (4 * firsts).tolist(), (4 * lasts).tolist(), strict=True))
            else:
                left += part
        return left

    def learn(self, chunks: list[bytes]) -> None:
        """Plain letters go together between blanks, others between semicolons. Chunks whose normal form may hold a
        semicolon are encoded by themselves."""
        plain, mixed, alone = [], [], []
        for w in chunks:
            text = w.decode("utf-8", "replace")
            if w and PLAIN.fullmatch(text):
                plain.append((w, text))
            else:
                odd = b";" in w or not w.isascii() and ";" in unicodedata.normalize("NFC", text)
                (alone if odd else mixed).append((w, text))
        joint = np.frombuffer(self.joint, "<u4")[0]

        def by_group(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ends = np.flatnonzero(self.last[ids]) + 1
            return np.r_[0, ends[:-1]], ends

        def by_joint(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(ids == joint)
            return np.r_[0, at + 1], np.r_[at, len(ids)]

        mixed += self.together(plain, " ", self.letters, by_group)
        alone += self.together(mixed, " ; ", self.tokenizer, by_joint)
        self.update(zip([w for w, _ in alone], self.ids([text for _, text in alone]), strict=True))

    def streams(self, texts: pa.Array | list[bytes | None]) -> list[bytes]:
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_binary()), b"").cast(pa.large_binary())
        # a copy whose offsets start at 0: ascii_lower misreads those of a slice
        texts = texts.take(pa.array(np.arange(len(texts))))
        if not self.chunked:
            return self.ids([x.decode("utf-8", "replace") for x in texts.to_pylist()])
        lower = pc.ascii_lower(texts.view(pa.large_string())).view(pa.large_binary())
        # a special token's own string is matched before lower-casing
        special = np.zeros(len(texts), bool)
        for t in self.added:
            special |= pc.match_substring(lower, t).to_numpy(zero_copy_only=False)
        special = np.flatnonzero(special)
        if len(special):
            whole = [texts[int(k)].as_py().decode("utf-8", "replace") for k in special]
            keep = np.ones(len(texts), bool)
            keep[special] = False
            out = dict(zip(special.tolist(), self.ids(whole), strict=True)) | dict(zip(np.flatnonzero(keep).tolist(), self.streams(texts.filter(pa.array(keep))), strict=True))
            return [out[k] for k in range(len(texts))]
        words = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        told = words.flatten().dictionary_encode()
        _, offsets, data = told.dictionary.buffers()
        ends, data = np.frombuffer(offsets, np.int64, len(told.dictionary) + 1).tolist(), data.to_pybytes() if data else b""
        chunks = [data[a:b] for a, b in zip(ends, ends[1:])]
        if len(self) > self.most:
            self.clear()
        found = [*map(self.get, chunks)]
        holes = [k for k, x in enumerate(found) if x is None]
        new = [chunks[k] for k in holes]
        stem = {w: core for w in new if w[-1:] in SIGNS and (core := w.rstrip(SIGNS))[-1:].isalpha()}
        parts = {*stem.values(), *(w[len(core) :] for w, core in stem.items())}
        self.learn([*({*(w for w in new if w not in stem), *parts} - self.keys())])
        for w, core in stem.items():
            self[w] = self[core] + self[w[len(core) :]]
        for k, w in zip(holes, new, strict=True):
            found[k] = self[w]
        joined = pa.array(found, pa.large_binary()).take(told.indices)
        # the ids of all chunks lie one after another: a text's are a slice
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64, len(joined) + 1)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


@functools.cache
def encoder(path: str | None) -> Encoder:
    """One for a Python worker: reading the file is slow."""
    return Encoder(path)


def forget(path: str | None) -> None:
    """Give back what a task has learnt: the worker lives on, and later stages need the memory."""
    encoder(path).clear()
    pa.default_memory_pool().release_unused()


def pieces(docs: DataFrame, params: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; ``ids`` (array of int) too if asked for."""
    whole, end = 4 * params.length, np.array([params.end_id], "<u4").tobytes()

    def make():
        streams = encoder(params.vocabulary).streams

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            rows, ids = [], []
            for doc_id, stream in zip(b["doc_id"].to_pylist(), streams(b["text"]), strict=True):
                stream += end
                for at in range(0, len(stream), whole):
                    part = stream[at : at + whole]
                    rows.append((doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(stream) // 4))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            more = {"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}
            return as_batch(**{n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), cols, strict=True)}, **more)

        return work

    raw = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(raw, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids, rows=500, done=functools.partial(forget, params.vocabulary))


Pattern = tuple[tuple[int, int], ...]  # (class, how many), classes falling


def knapsack(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, Counter]:
    """The best multiset of items of total size up to ``room``, by dynamic programming over the room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for u in range(1, room + 1):
        best[u] = best[u - 1]
        fits = sizes[: np.searchsorted(sizes, u, "right")]
        if len(fits):
            gain = worth[: len(fits)] + best[u - fits]
            k = int(gain.argmax())
            if gain[k] > best[u] + 1e-12:
                best[u], took[u] = gain[k], k
    items, u = Counter(), room
    while u > 0:
        if took[u] < 0:
            u -= 1
        else:
            items[int(took[u])] += 1
            u -= int(sizes[took[u]])
    return float(best[room]), items


def inverted(a: np.ndarray) -> np.ndarray:
    """Gauss and Jordan with row exchange, by plain array operations: the linear algebra library's threads can stall a
    driver that serves a JVM."""
    m = len(a)
    both = np.hstack([a.astype(float), np.eye(m)])
    for k in range(m):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.outer(factor, both[k])
    return both[:, m:]


def column_generation(demand: dict[int, int], room: int, rounds: int, gap: float) -> list[tuple[Pattern, float]]:
    """Patterns and how often each is used in the linear program: least sequences that hold ``demand`` items by size."""
    sizes = np.array(sorted(demand))
    need, m = np.array([demand[int(s)] for s in sizes], float), len(sizes)
    # first patterns: each class in falling order with smaller ones that fit and are still there in that number, so the
    # matrix is triangular and no count is negative
    columns, x, rest = np.zeros((m, m)), np.zeros(m), need.copy()
    for c in range(m - 1, -1, -1):
        columns[c, c] = room // sizes[c]
        x[c] = rest[c] / columns[c, c]
        gap_left, rest[c] = room - columns[c, c] * sizes[c], 0
        for d in range(min(c, int(np.searchsorted(sizes, gap_left, "right"))) - 1, -1, -1) if x[c] else ():
            n = min(gap_left // sizes[d], rest[d] // x[c])
            columns[d, c] = n
            rest[d] -= n * x[c]
            gap_left -= n * sizes[d]
    inverse = inverted(columns)
    cost = np.ones(m)  # of the columns: a pattern costs a sequence, a surplus of one class nothing
    centre, bound = sizes / room, float(need @ sizes) / room  # prices by size: what no plan can beat
    for k in range(rounds):
        worth = np.einsum("i,ij->j", cost, inverse)
        if x @ cost - bound <= gap * bound:
            break
        column, price_of = np.zeros(m), 1.0
        if worth.min() < -1e-9:
            column[int(worth.argmin())], price_of = -1, 0.0
        else:
            # prices are held near the best ones so far, else small items swing between worthless and dear
            for near in (0.7, 0.0):
                price = near * centre + (1 - near) * np.maximum(worth, 0)
                value, items = knapsack(sizes, price, room)
                least = float(need @ price) / max(1.0, value)
                if least > bound:
                    centre, bound = price / max(1.0, value), least
                if sum(n * worth[i] for i, n in items.items()) > 1 + 1e-9:
                    break
            else:
                break
            for item, n in items.items():
                column[item] = n
        step = np.einsum("ij,j->i", inverse, column)  # no threads for so small a product
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out], cost[out] = column, price_of
        if k % 200 == 199:
            inverse = inverted(columns)
            x = np.einsum("ij,j->i", inverse, need)
        else:
            t = ratio[out]
            x = x - t * step
            x[out] = t
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
    return [(tuple((int(sizes[i]), int(columns[i, j])) for i in np.flatnonzero(columns[:, j])[::-1]), float(x[j])) for j in range(m) if cost[j]]


def plan(histogram: dict[int, int], params: PackParams = PackParams()) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences each makes; together they hold each item of the histogram once."""
    room, left = params.length // params.grain, Counter({int(k): int(v) for k, v in histogram.items() if v})
    if not left:
        return []
    out = []
    for pattern, times in column_generation(dict(left), room, params.rounds, params.gap):
        times = min([int(times + 1e-6), *(left[c] // n for c, n in pattern)])
        if times > 0:
            out.append((pattern, times))
            left.subtract({c: n * times for c, n in pattern})
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    for c in sorted(left, reverse=True):  # what rounding leaves: a few items a pattern
        for _ in range(left[c]):
            size = next((r for r in range(c, room + 1) if free.get(r)), None)
            if size is None:
                bins.append([])
                size, at = room, len(bins) - 1
            else:
                at = free[size].pop()
            bins[at].append(c)
            free.setdefault(size - c, []).append(at)
    return out + [(tuple(sorted(Counter(b).items(), reverse=True)), 1) for b in bins]


def slots(patterns: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """For each class in order the ranks from which a pattern takes its items: class, first rank, items in a
    sequence, the pattern's first sequence."""
    rows, used, base = [], Counter(), 0
    for pattern, times in patterns:
        for c, n in pattern:
            rows.append((c, used[c], n, base))
            used[c] += n * times
        base += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(spark: SparkSession, docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    scratch = Scratch(spark)
    cut = scratch.cut(pieces(docs, params).withColumn("cls", F.ceil(F.col("length") / params.grain).cast("int")), "pieces")
    histogram = {r["cls"]: r["count"] for r in cut.groupBy("cls").count().collect()}  # one row a length class
    patterns = plan(histogram, params)
    told = spark.sparkContext.broadcast(slots(patterns))
    buckets = max(16, sum(histogram.values()) // params.per_bucket)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("cls", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("cls", "bucket", (F.sum("n").over(W.partitionBy("cls").orderBy("bucket")) - F.col("n")).alias("before"))
    order = W.partitionBy("cls", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(before, ["cls", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def make():
        cls, first, per, base = told.value
        keys = (cls << 44) + first

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            c, rank = b["cls"].to_numpy().astype(np.int64), b["rank"].to_numpy()
            at = np.searchsorted(keys, (c << 44) + rank, "right") - 1
            cols = {n: b[n] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            return as_batch(**cols, sequence_id=pa.array(base[at] + (rank - first[at]) // per[at]))

        return work

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    placed = map_rows(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank"), make, schema, rows=100_000)
    within = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the pieces of every document."""
    return pack(spark, documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the pieces of all documents that are left."""
    return pack(spark, docs.select("doc_id", "text"))
