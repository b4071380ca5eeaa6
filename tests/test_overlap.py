"""Neighbours by token overlap against the search of all against all."""

import random

import numpy as np
import pytest

from echolode.config import Thresholds
from echolode.operators import knn, matches, overlap

T = Thresholds()
LEAST = (min(T.func, T.win, T.exp) - T.lexical_weight) / (1 - T.lexical_weight)


def rows(rng, n):
    """(pos, vec, tokens): texts and near copies of them, whole copies, equal vectors of other tokens, vectors that differ by less than a score shows, and odd rows."""
    unit = lambda: [rng.random() for _ in range(5)]
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [(unit(), sorted({rng.choice(words) for _ in range(rng.choice((3, 10, 40)))})) for _ in range(n // 4)]
    out = list(texts)
    while len(out) < n:
        vec, tokens = rng.choice(texts)
        kind = rng.randrange(5)
        if kind == 1:
            vec = unit()
        if kind == 2:
            vec = [x + rng.uniform(-0.1, 0.1) for x in vec]
        if kind == 3:
            vec = [x + rng.uniform(-1e-6, 1e-6) for x in vec]
        if kind in (1, 2, 4):
            tokens = sorted({t for t in tokens if rng.random() > 0.15} | {f"n{rng.randrange(9000)}"})
        out.append((vec, tokens))
    out += [([0.0] * 5, ["a", "b"])] * 2 + [(None, ["a"]), ([], ["a"]), (unit(), []), (unit(), [])]
    return [(k, v, t, "WIN", f"f{k}", f"p{k}", 1, 9, 1, 9, f"h{k}") for k, (v, t) in enumerate(out)]


SCHEMA = "pos long, vec array<double>, tokens array<string>, kind string, fn_id string, path string, fn_start int, fn_end int, start_line int, end_line int, snippet_hash string"


@pytest.mark.parametrize(("n", "k"), [(1200, 3), (400, 25)])
def test_same_candidates_and_few_vectors_ask(spark, monkeypatch, n, k):
    s = spark.createDataFrame(rows(random.Random(n), n), SCHEMA).cache()
    seen, of = [], knn.ask
    monkeypatch.setattr(overlap.knn, "ask", lambda d, *a, **b: seen.append(d.where("asks").count()) or of(d, *a, **b))
    found = lambda near: sorted((r.a_pos, r.b_pos, r.cosine, r.similarity) for r in matches.candidates(s, near, T).collect())
    got, want = found(overlap.near(s, k, LEAST, T)), found(knn.knn(s.select("pos", "vec"), k, LEAST))
    assert got == want and len(got) > n / 10
    assert seen and seen[0] < 0.7 * n  # before, each vector was held against each other one


def test_texts_apart_ask_nothing(spark, monkeypatch):
    rng, seen, of = random.Random(8), [], knn.ask
    d = [(k, [rng.random() for _ in range(16)], [f"t{k}-{x}" for x in range(9)] + ["the", "of"], "WIN", f"f{k}", f"p{k}", 1, 9, 1, 9, f"h{k}") for k in range(900)]
    monkeypatch.setattr(overlap.knn, "ask", lambda d, *a, **b: seen.append(d.where("asks").count()) or of(d, *a, **b))
    assert not overlap.near(spark.createDataFrame(d, SCHEMA), 25, LEAST, T).count()
    assert seen == [0]


@pytest.mark.parametrize("matrix", [2, 9, 10**6])
def test_entries_lose_no_pair(monkeypatch, matrix):
    monkeypatch.setattr(overlap, "MATRIX", matrix)
    monkeypatch.setattr(knn, "TILE", (5, 7))
    rng, r = random.Random(matrix), overlap.needed(T)
    base = [[rng.randrange(40) for _ in range(rng.choice((4, 12, 30)))] for _ in range(9)]
    sets = [{x for x in rng.choice(base) if rng.random() > 0.1} | {rng.randrange(400)} for _ in range(150)]
    vecs = np.random.default_rng(matrix).random((150, 6))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    floor = np.random.default_rng(1).uniform(0.86, 0.95, 150)
    e = []
    for k, x in enumerate(sets):
        first = sorted(x, reverse=True)[: len(x) - int(np.ceil(r * len(x) - 1e-6)) + 1]
        e += [(t, k, len(x), len(x) - p, floor[k] - overlap.SLACK, np.rint(vecs[k] * 32767).astype(np.int16)) for p, t in enumerate(first)]
    got = overlap.meet(np.array(e, overlap._entry(6)), r, T)
    said = dict(zip(zip(got["a"].tolist(), got["b"].tolist(), strict=True), zip(got["asks_a"], got["asks_b"], got["cosine"], strict=True), strict=True))
    want = 0
    for i in range(150):
        for j in range(i + 1, 150):
            lexical, cosine = len(sets[i] & sets[j]) / len(sets[i] | sets[j]), float(vecs[i] @ vecs[j])
            if 0.7 * cosine + 0.3 * lexical >= 0.9 and lexical >= 0.5 and cosine >= min(floor[i], floor[j]):
                a, b, most = said[i, j]
                assert a >= (cosine >= floor[i]) and b >= (cosine >= floor[j]) and most >= cosine
                want += 1
    assert want > 20 and len(said) == len(got["a"])
