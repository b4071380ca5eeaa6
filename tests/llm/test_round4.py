"""Hard negatives, manifest and byte network: against brute force and SQL, with nulls, ties, repeated rows, odd texts."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echolode.llm import byte_cnn, dual_tree, manifest

# --- op11


def brute_negatives(rows, k_positive=5, k_negative=5):
    """By plain loops over (vec_id, label, vector)."""
    known = set()
    for vec_id, label, vec in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        known.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec)))
    out = []
    for a, label, x in known:
        if a % 100:
            continue
        score = lambda y: sum(p * q for p, q in zip(x, y))  # noqa: B023, B905, E731
        others = [(-score(y), b, mine) for b, mine, y in known]
        for s, b, _ in sorted(o for o in others if o[2] == label and o[1] != a)[:k_positive]:
            fits = sorted(o for o in others if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s)[:k_negative]
            out += [(a, b, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return sorted(out)


def vectors(n, dim, seed):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for k in range(n):
        c = rng.choice(centers)
        rows.append((k, rng.randrange(3), [float(np.float32(x + rng.gauss(0, 0.15))) for x in c]))
    for k in range(0, n, 5):  # copies, which tie, with other ids and labels
        rows.append((n + k, rng.randrange(3), rows[k][2]))
    return rows


SMALL = dual_tree.TreeParams(depth=4, leaf_rows=20, sample_bytes=4000, block_bytes=200, bunch=4, group=2, slice=3)


def mined(spark, rows, p=SMALL):
    table = spark.createDataFrame([(*r, "extra", 1) for r in rows], "vec_id long, label int, embedding array<float>, leaf string, block int")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = dual_tree.mine(spark, dual_tree.known(table, "vec_id", label, "embedding"), F.col("id") % 100 == 0, p=p)
    return sorted(tuple(r) for r in found.collect())


def test_hard_negatives_brute_force(spark):
    rows = vectors(420, 6, 3)
    # what takes no part, a repeated row, a row of an anchor's id with another vector, shorter and empty vectors, ids without an order
    rows += [(None, 1, rows[0][2]), (9001, None, rows[0][2]), (9002, 1, None), (9003, 1, [None] + rows[0][2][1:]), (9004, 1, [float("nan")] * 6), (9005, 1, [float("inf")] + [0.0] * 5)]
    rows += [rows[0], rows[0], (300, 2, rows[17][2]), (9006, 1, rows[0][2][:3]), (9007, 2, []), (-100, 1, rows[1][2]), (-7, 1, rows[1][2])]
    assert mined(spark, rows) == brute_negatives(rows) != []


def test_hard_negatives_hot_vector_and_integers(spark):
    # a third of all rows has one vector, so whole blocks tie; components beyond what 32-bit floats hold exactly
    rng = random.Random(5)
    rows = [(k, k % 4, [3.0, 1.0, -2.0] if k % 3 == 0 else [rng.uniform(-9, 9) for _ in range(3)]) for k in range(301)]
    wide = [(i, lab, [x * 4e4 for x in vec]) for i, lab, vec in rows]
    assert mined(spark, rows) == brute_negatives([(i, lab, [float(np.float32(x)) for x in vec]) for i, lab, vec in rows]) != []
    assert mined(spark, wide) == brute_negatives([(i, lab, [float(np.float32(x)) for x in vec]) for i, lab, vec in wide]) != []


def test_hard_negatives_without_rows(spark):
    assert mined(spark, [(None, None, None)]) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []  # no anchor
    assert mined(spark, [(100, 1, [1.0])]) == [] == mined(spark, [(100, 1, [1.0]), (1, 2, [1.0])])  # no positive
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(100, 1, [3e38])])


def test_walk_drops_only_what_cannot_help():
    rng = np.random.default_rng(1)
    sets = [rng.integers(-40, 40, 5) * 4 + rng.integers(-3, 4, (9, 5)) for _ in range(8)]
    leaves = dual_tree.Nodes.of([s.astype(float) for s in sets])
    heap = [None] * 7 + [leaves.take([k]) for k in range(8)]
    for c in range(6, -1, -1):
        heap[c] = heap[2 * c + 1].merged(heap[2 * c + 2])
    x = np.concatenate([sets[2][:4], sets[5][:3]])
    s = x @ np.concatenate(sets).T
    ceil = np.full((7, 1), 1 << 62)
    kth = np.sort(s, axis=1)[:, -3, None]
    bunch = dual_tree.Bunch(np.arange(7), np.arange(7), np.zeros(7), x, -ceil, ceil, kth, 3, 2)
    found = dual_tree.walk(bunch, heap)
    needed = {j // 9 for i in range(7) for j in np.flatnonzero(s[i] >= kth[i, 0])}
    assert needed <= set(found) and len(found) < 8


# --- op12

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Levels as lists of lists, by (doc_id, text, lang, source, n_chars)."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    of = lambda r, more=0: H(said(r[0]), said(r[3]), said(r[2]), said(r[4] if r[4] is None else r[4] + more), said(r[1]))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, at):
        return [(at >> n & 1, x[at >> n ^ 1] if at >> n ^ 1 < len(x) else None) for n, x in enumerate(levels[:-1])]

    def fold(digest, steps):
        for odd, other in steps:
            digest = H(digest) if other is None else H(other, digest) if odd else H(digest, other)
        return digest

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, of(r)))
        trees[lang] = own, tree([of(r) for r in own])
    top = tree([trees[x][1][-1][0] for x in langs])
    for up, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            steps = way(levels, at) + way(top, up)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            folded = fold(of(r, bad), steps)
            out.append((r[0], of(r), levels[-1][0], top[-1][0], H(*(x for _, x in steps if x)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(n):
    rng = random.Random(n)
    langs = [None, "de", "en", "en", "en", "fr", "é", "", "zz-top"]
    rows = [(k, "x" * rng.randrange(9) or None, rng.choice(langs), rng.choice([None, "", "src", "sé"]), rng.choice([None, 3, 10])) for k in range(n)]
    return rows + rows[:2] + rows[:1] + [(None, "a", "en", None, None), (None, None, None, None, None), (-5, "w " * 30_000, "en", "s", 60_000)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("levels", [1, 3, 16])
@pytest.mark.parametrize("n", [1, 130])
def test_manifest_brute_force(spark, tmp_path, n, levels):
    """Passes of one, three and all levels, so that ways go through several tables of boundary nodes."""
    rows = manifest_rows(n)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumn("g", F.lit(1)).withColumn("digest", F.lit("clash")).withColumn("at", F.lit(7))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in manifest.query(spark, str(tmp_path), levels).collect()), key=str)
    assert got == brute_manifest(rows)
    db = duckdb.connect()
    db.execute(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    assert sorted((tuple(r) for r in db.sql(f"SELECT {cols} FROM ({manifest.SQL})").fetchall()), key=str) == got


def test_manifest_without_rows(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest.query(spark, str(tmp_path)).collect() == []


def test_manifest_shuffled_nodes(spark, tmp_path, monkeypatch):
    """The same where tables of nodes and counts are too large to broadcast."""
    monkeypatch.setattr(manifest, "BROADCAST_BYTES", 0)
    rows = manifest_rows(90)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in manifest.query(spark, str(tmp_path), 2).collect()), key=str) == brute_manifest(rows)


# --- op13


def plain_logit(data, net, block):
    """The network by plain loops over places, filters and chunks."""
    if data:
        data = data + bytes(max(0, len(net.table) - len(data)))
        places = [[sum(float(net.table[k][data[t + k]][f]) for k in range(len(net.table))) for f in range(net.table.shape[2])] for t in range(len(data) - len(net.table) + 1)]
        blocks = [[max(p[f] for p in places[s : s + block]) for f in range(net.table.shape[2])] for s in range(0, len(places), block)]
        tops = [[max(x, y) for x, y in zip(a, b, strict=True)] for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
        x = [np.maximum(np.array(t) + net.bias, 0) for t in tops]
    else:
        x = [np.zeros(len(net.bias))]
    h = [np.maximum(r @ net.dense + net.offset, 0) for r in x]
    return float(np.concatenate([np.max(h, axis=0), np.mean(h, axis=0)]) @ net.out + net.last[0])


TINY = byte_cnn.CnnParams(width=4, filters=5, hidden=3, block=8)


def test_network_plain_loops(monkeypatch):
    monkeypatch.setattr(byte_cnn, "SLICE", 16)
    net, rng = byte_cnn.fresh(TINY), np.random.default_rng(2)
    for n in (0, 1, 3, 4, 8, 11, 12, 27, 100):
        data = bytes(rng.integers(0, 256, n, np.uint8))
        assert byte_cnn.forward(byte_cnn.blocks_of(data, net, 8, False)[0], net)[0] == pytest.approx(plain_logit(data, net, 8), abs=1e-4)
    assert byte_cnn.score_text(None, net, 8) == byte_cnn.score_text(b"", net, 8)


def test_network_gradients(monkeypatch):
    """Back-propagation against differences of the loss."""
    monkeypatch.setattr(byte_cnn, "SLICE", 16)
    data, label = bytes(np.random.default_rng(4).integers(97, 103, 61, np.uint8)), 1
    net = byte_cnn.fresh(TINY)
    net = byte_cnn.Network(*(w.astype(np.float64) for w in net.parts()))
    grads = [np.zeros_like(w) for w in net.parts()]
    byte_cnn.backward(data, label, net, 8, grads)
    loss = lambda: np.log1p(np.exp(-byte_cnn.forward(byte_cnn.blocks_of(data, net, 8, False)[0], net)[0]))
    for w, g in zip(net.parts(), grads, strict=True):
        for at in [tuple(x) for x in np.argwhere(g != 0)[:12]] + [tuple(np.zeros(w.ndim, int))]:
            old = w[at]
            w[at] = old + 1e-6
            high = loss()
            w[at] = old - 1e-6
            assert (high - loss()) / 2e-6 == pytest.approx(g[at], abs=2e-4)
            w[at] = old


def test_quality_held_out(spark, tmp_path):
    rng = random.Random(8)
    words = "sun tree river stone cloud bird field house road light".split()
    texts, good = [], []
    for _ in range(600):
        ok = rng.random() < 0.7
        own = rng.choices(words, k=60)
        if not ok:
            own = [w.upper() + "!!" for w in own] if rng.random() < 0.5 else own[:20] + [own[0]] * 40
        texts.append(" ".join(own))
        good.append(int(ok))
    odd = [None, "", "x", "wörd", "lorem ipsum " * 20_000]
    rows = [*((k, t, "en", 0.5, 1) for k, t in enumerate(texts + odd)), (0, texts[0], "en", 0.5, 1), (None, "no id", "en", 0.5, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([*((k, q, 0) for k, q in enumerate(good)), (5, None, 0), (None, 1, 0), (77_777, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = byte_cnn.query(spark, str(tmp_path), byte_cnn.CnnParams(epochs=8)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    held = [(r.predicted, good[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and len({r.score for r in got if r.doc_id in (600, 601)}) == 1


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    score = lambda labels: [r.s for r in docs.select(byte_cnn.scorer(spark, byte_cnn.train(docs, labels))(F.col("text")).alias("s")).collect()]
    assert max(score(none)) < 1e-9 and min(score(one)) > 1 - 1e-9
    assert docs.limit(0).select(byte_cnn.scorer(spark, byte_cnn.train(docs.limit(0), one))(F.col("text")).alias("s")).count() == 0
