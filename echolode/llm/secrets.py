"""Secret scan with a password guess-cost model.

Base spans come from three fixed patterns. The method adds spans of kind ``guess``: the value of a credential context
that no base span holds whole, where the least number of guesses for it is high. The number is a dynamic program
over the value: its cheapest segmentation into dictionary words, dates, repeats, keyboard walks and brute-force
characters, in log10 guesses; letters alone are no exception. ``n_weak`` counts assign values that a guesser would find soon (their spans stay).

A null or empty text has no span. Spans are of whole matches, in code points, end exclusive; very long texts are
scanned whole, as bytes, and only those that may hold a secret are decoded, with U+FFFD for bytes that are no UTF-8. A
value's time grows with its length. Repeated rows get equal results, a null doc_id is kept, an empty table gives
no rows; extra columns aren't read by the query and pass through the stage as they are. Equal starts are ordered by kind.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, documents, map_rows

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# contexts of credentials whose value the base patterns may not take whole: a name that holds a keyword (looked for once
# from the name's beginning, so that long names cost no more than their length), or a bare bearer
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?(?ai:password|passwd|passphrase|passcode|pwd|secret|token|(?:api|private|access)[_.-]?key|credential|authorization|bearer))[A-Za-z0-9_.-]++["']?\s{0,3}(?:[:=]|\bis\b)\s{0,3}(?:(?ai:bearer|basic)\x20+)?["']?(?=[^\s"'<>,;]{8})"""
)
BEARER = re.compile(r"""(?<![A-Za-z0-9])(?ai:bearer)\s{1,3}["']?(?![:=])(?=[^\s"'<>,;]{8})""")
#: what a value of a context can't hold; a value begins where the pattern's match ends
STOP = re.compile(r"""[\s"'<>,;]|\Z""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"passphrase", b"passcode", b"pwd", b"credential", b"authorization", b"bearer", *(a + s + b"key" for a in (b"api", b"private", b"access") for s in (b"", b"_", b"-", b".")))
HEXED = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))

# Words that guessers try first, most frequent first; after them the words of a public vocabulary.
COMMON = """password admin welcome login secret master letmein dragon monkey shadow sunshine princess football baseball
qwerty iloveyou superman batman trustno hello freedom whatever ninja mustang access flower cheese computer internet
service test user guest root default changeme example sample token public private server database backup system
summer winter spring autumn monday friday january december love money lucky magic tiger eagle silver golden orange
purple black white green blue red apple google amazon github linux windows oracle mysql postgres docker kubernetes
your here key value none null true false""".split()


def dictionary() -> dict[str, int]:
    """Rank of each word: COMMON, then the whole words of the vocabulary in its order, which is that of merges."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocab = json.load(f)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in sorted(vocab, key=vocab.get) if w.endswith("</w>"))
    return {w: k + 1 for k, w in enumerate(dict.fromkeys([*COMMON, *(w for w in whole if len(w) >= 3 and w.isalpha())]))}


RANK = dictionary()
LONGEST = max(map(len, RANK))
LEET = str.maketrans("@4301$5!7", "aaeolssit")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.A)
#: longest block whose repeats are a segment
BLOCK = 8
#: log10 guesses for taking one more segment: the guesser must also find where segments begin
JOINT = 0.3


def brute(c: str) -> float:
    """log10 of the alphabet that a brute-force guesser needs for one character."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class Runs:
    """Of a value: where what is said again, the same characters and keyboard walks end, from any place. Each table is
    made once, in linear time, and serves all the value's ends as well."""

    def __init__(self, value: str) -> None:
        self.value, self.n = value, len(value)
        low = value.lower()
        self.low = low if len(low) == self.n else "".join(y if len(y := x.lower()) == 1 else x for x in value)
        self.plain = self.low.translate(LEET)
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        # places whose character isn't that of the place a block later
        self.breaks = {block: np.flatnonzero(codes[:-block] != codes[block:]) for block in range(1, min(BLOCK, self.n - 1) + 1)}
        self.steps = np.flatnonzero([x not in NEXT for x in zip(self.low, self.low[1:], strict=False)])

    def periodic(self, i: int, block: int) -> int:
        """Length of what starts at ``i`` and repeats its first ``block`` characters, in part at last."""
        if block not in self.breaks:
            return min(block, self.n - i)
        at = self.breaks[block]
        k = int(at.searchsorted(i))
        return (int(at[k]) + block if k < len(at) else self.n) - i

    def walk(self, i: int) -> int:
        k = int(self.steps.searchsorted(i))
        return (int(self.steps[k]) + 1 if k < len(self.steps) else self.n) - i


def guesses(value: str | Runs, limit: float = math.inf, start: int = 0) -> float:
    """log10 of the guesses for ``value`` from ``start``: the least sum over its segmentations, or ``limit`` if that is no
    more. Places that can't be reached below the limit are never looked at."""
    runs = value if isinstance(value, Runs) else Runs(value)
    value, low, plain, n = runs.value, runs.low, runs.plain, runs.n
    best, todo = {start: 0.0}, [start]
    while todo:
        i = heapq.heappop(todo)
        here = best.pop(i)
        if i == n:
            return min(limit, here)

        def take(end: int, cost: float, here: float = here) -> None:
            if here + cost < limit:
                if end not in best:
                    heapq.heappush(todo, end)
                best[end] = min(best.get(end, math.inf), here + cost)

        take(i + 1, brute(value[i]))
        for end in range(i + 3, min(n, i + LONGEST) + 1):
            if rank := RANK.get(plain[i:end]):
                odd = (low[i:end] != plain[i:end]) + (value[i:end] != low[i:end])
                take(end, math.log10(1 + rank) + JOINT * (1 + odd))
        for m in [DATE.match(value, i)] if value[i].isdigit() else []:
            if m:
                take(m.end(), JOINT + (math.log10(130) if m.end() - i == 4 else math.log10(130 * 365)))
        walk, same = runs.walk(i), runs.periodic(i, 1)
        for length in {3, walk} if walk >= 3 else ():
            take(i + length, JOINT + math.log10(4 * 47 * length))
        for length in {3, same} if same >= 3 else ():
            take(i + length, JOINT + brute(value[i]) + math.log10(length))
        for block in range(2, min(BLOCK, (n - i) // 2) + 1):  # a block said again and again
            if (times := runs.periodic(i, block) // block) > 1:
                take(i + times * block, JOINT + sum(map(brute, value[i : i + block])) + math.log10(times))
    return limit


@dataclass(frozen=True)
class SecretParams:
    """``strong``: least log10 guesses for a context's value to be taken as a secret; ``weak``: at most, for n_weak."""

    strong: float = 11.0
    weak: float = 8.0


class Cover:
    """Whether one of some spans holds a range whole, by a search among their starts."""

    def __init__(self, held: Iterable[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(held):
            self.starts.append(a)
            self.ends.append(max(b, self.ends[-1] if self.ends else b))

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.ends[k - 1] >= b


def spans(text: str, params: SecretParams = SecretParams()) -> tuple[list[tuple[int, int, int]], int]:
    """(start, kind number, end) of all spans, in order, and how many assign values are weak."""
    out, weak = [], 0
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
            weak += guesses(m[2], params.weak + 1e-9) <= params.weak
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for pattern in (CONTEXT, BEARER):
        cover, runs, since, b = Cover((a, b) for a, _, b in out), None, 0, 0
        m = pattern.search(text)
        while m:
            a = m.end()
            if a >= b:
                b, runs = STOP.search(text, a).start(), None
            inside = cover.holds(a, b)
            if not inside and runs is None:
                runs, since = Runs(text[a:b]), a  # values within it end where it ends and share its tables
            strong = not inside and guesses(runs, params.strong, a - since) >= params.strong
            if strong:
                out.append((a, 3, b))
            # a value that is no secret may be the name of the next one
            m = pattern.search(text, b if inside or strong else a)
    return sorted(out), weak


def may_hold(data: bytes) -> bool:
    """False only if no pattern can match: bytes are searched, nothing is decoded."""
    low = data.lower()
    return any(k in low for k in KEYWORDS) or b"AKIA" in data or b"\x01" * 32 in data.translate(HEXED)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, found (array of kind, start, end, value), n_weak of every row."""

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            found, weak = [], []
            for data in b["text"].to_pylist():
                text = data.decode("utf-8", "replace") if data and may_hold(data) else ""
                s, w = spans(text, params)
                found.append([{"kind": KINDS[k], "start": a, "end": e, "value": text[a:e]} for a, k, e in s])
                weak.append(w)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            return as_batch(doc_id=b["doc_id"], found=pa.array(found, kind), n_weak=pa.array(weak, pa.int64()))

        return work

    schema = "doc_id long, found array<struct<kind string, start long, end long, value string>>, n_weak long"
    return map_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")), make, schema)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of scan()'s rows, by built-in functions."""
    said = lambda of: F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(said(F.filter("found", lambda x: x["kind"] != "guess")).cast("binary"), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
        count("guess"),
        "n_weak",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the spans of every document."""
    return digest(scan(documents(spark, sf_dir)))


def redact(text: str, params: SecretParams = SecretParams()) -> str:
    """The text with every span replaced by its kind; spans that overlap are replaced as one, by the first's kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans(text, params)[0]:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k]}]"]
        at = b
    return "".join([*out, text[at:]])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets are replaced by their kind; n_chars follows the text."""

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x if x is None or not may_hold(x) else redact(x.decode("utf-8", "replace")).encode() for x in b["text"].to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if n == "text" else b[n] for n in b.schema.names], names=b.schema.names)

        return work

    raw = docs.withColumn("text", F.col("text").cast("binary"))
    done = map_rows(raw, make, raw.schema).withColumn("text", F.col("text").cast("string"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)
