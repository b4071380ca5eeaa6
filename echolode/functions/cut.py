"""Windows of many texts at once: where lines, windows and tokens are, by the bytes of all texts together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import syntax

#: bytes of texts, and tokens of windows, that are looked at together
TEXT_BYTES, TOKENS = 4 << 20, 1 << 20
#: a token's byte in lower case, 0 for others; bytes that aren't blank; those with which a line end other than a line feed, a wider
#: blank or a character that has an ASCII letter as its lower case may begin
WORD = np.array([x if x != 32 else 0 for x in bytes(range(256)).lower().translate(syntax.APART)], np.uint8)
INK = np.array([not bytes([x]).decode("latin-1").isspace() or x > 127 for x in range(256)])
RARE = np.isin(np.arange(256), [0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0xC2, 0xC4, 0xE1, 0xE2, 0xE3])
ODD = re.compile("[\r\x0b\x0c\x1c-\x1e\x85\xa0İ  -     K　]")
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _tokens(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin, and a hash of 64 bits of each; of tokens of up to 8 bytes no two have one hash."""
    low = np.concatenate([WORD[buf], np.zeros(16, np.uint8)])
    edges = np.flatnonzero(np.diff((low != 0).view(np.int8), prepend=np.int8(0)))
    start, size = edges[::2], edges[1::2] - edges[::2]
    words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the eight bytes from each place
    h = _mixed(words[start] & MASKS[np.minimum(size, 8)])
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        h[more] = _mixed((h[more] + np.uint64(k)) ^ (words[start[more] + k] & MASKS[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    return start, h


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one, each with a line feed at its end, where its lines begin and end, and how many lines a text has."""
    whole = [x if not x or x.endswith(b"\n") else x + b"\n" for x in texts]
    buf = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.flatnonzero(buf == 10)
    upto = np.searchsorted(ends, np.cumsum([len(x) for x in whole]))
    return buf, ends, np.diff(upto, prepend=0)


def told(paths: list[str], texts: list[bytes], size: int, stride: int, least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of snippets.TOLD of texts."""
    plain, spoken, inks = [], [], {}
    for k, x in enumerate(texts):
        odd = RARE[np.frombuffer(x, np.uint8)].any() and ODD.search(x.decode())
        lines = x.decode().splitlines() if odd else []
        plain.append("".join(y + "\n" for y in lines).encode() if odd else x)
        spoken.append(plain[-1].decode().lower().encode() if odd else x)
        if odd:
            inks[k] = [bool(y.strip()) for y in lines]
    buf, ends, count = _lines(plain)
    if not len(ends):
        return
    begins, off = np.r_[0, ends[:-1] + 1], np.cumsum(count) - count
    seen = np.cumsum(INK[buf], dtype=np.int64)
    ink = seen[ends] > np.r_[0, seen[ends[:-1]]]
    for k, x in inks.items():
        ink[off[k] : off[k] + count[k]] = x
    inked = np.r_[0, np.cumsum(ink)]
    heard, stops, _ = _lines(spoken) if inks else (buf, ends, count)
    start, h = _tokens(heard)
    known, rank = np.unique(h, return_inverse=True)
    upto = np.r_[0, np.searchsorted(start, stops)]  # tokens before each line
    many = -(-count // stride)
    doc = np.repeat(np.arange(len(texts)), many)
    first = off[doc] + (np.arange(len(doc)) - (np.cumsum(many) - many)[doc]) * stride
    last = np.minimum(first + size, (off + count)[doc])
    kept = (inked[last] - inked[first] >= least) & (inked[off + count] > inked[off])[doc]
    doc, first, last = doc[kept], first[kept], last[kept]
    length = upto[last] - upto[first]
    group = np.cumsum(length) // TOKENS
    data, own = memoryview(buf), {}
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(group)) + 1) if len(doc) else []:
        n = length[part]
        at = np.arange(n.sum()) + np.repeat(upto[first[part]] - (np.cumsum(n) - n), n)
        key = (np.repeat(np.arange(len(part), dtype=np.uint64), n) << np.uint64(32)) | rank[at].astype(np.uint64)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        edge = np.r_[0, np.cumsum(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(part)))]
        sets = known[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        raw, rows = memoryview(sets.tobytes()), []
        for k, i, a, b, lo, hi in zip(doc[part].tolist(), (first - off[doc])[part].tolist(), begins[first[part]].tolist(), ends[last[part] - 1].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if k not in own:
                own[k] = f"{paths[k]}:1:{count[k]}:{hashlib.sha256(texts[k]).hexdigest()}"
            upper = min(i + size, int(count[k]))
            said = hashlib.sha256(f"WIN:{own[k]}:{i + 1}:{upper}:".encode())
            said.update(data[a:b])
            fn = f"{paths[k]}:{paths[k].rsplit('/', 1)[-1]}:1:{count[k]}"
            rows.append(("WIN", fn, paths[k], 1, count[k], i + 1, upper, said.hexdigest(), hashlib.sha256(data[a:b]).digest(), hashlib.sha256(raw[8 * lo : 8 * hi]).digest()))
        codes = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((4 * edge).astype(np.int32).tobytes()), pa.py_buffer((sets >> np.uint64(32)).astype(np.uint32).tobytes())])
        yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=False)), codes], schema=schema)


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where to cut a batch of texts, for parts of about TEXT_BYTES."""
    at, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= TEXT_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    yield at, len(texts)
