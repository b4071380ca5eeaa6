"""Neighbours by cells against all neighbours."""

import random

import numpy as np

from echolode.operators import knn, matches


def test_cells_lose_no_neighbour(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)] + [(300, [0.0] * 8), (301, None), (302, [])]
    rows += [(400 + k, [rng.gauss(5 * (j == k % 8), 0.01) for j in range(8)]) for k in range(80)]
    v = spark.createDataFrame(rows, "pos long, vec array<double>").cache()
    want = {(r.a_pos, r.b_pos, r.rank) for r in knn.knn(v, 12).collect()}
    for cells, probes in ((16, 2), (40, 1), (8, 8)):
        assert {(r.a_pos, r.b_pos, r.rank) for r in knn.knn_cells(v, 12, cells, probes).collect()} == want


def test_blocks_give_their_best_only(spark, monkeypatch):
    # a task hands on k rows a vector, however many blocks there are; before it was k for each pair of blocks
    rng, seen, of = random.Random(4), [], knn._best
    rows = [(k, [rng.random() for _ in range(6)]) for k in range(500)] + [(1000 + k, [1.0] * 6) for k in range(30)]
    v = spark.createDataFrame(rows, "pos long, vec array<double>").cache()
    for tile in ((256, 4096), (7, 20)):
        monkeypatch.setattr(knn, "TILE", tile)
        for least in (None, 0.97):
            want = {(r.a_pos, r.b_pos, r.rank) for r in knn.knn_sql(v, 9).collect() if r.score >= (least or 0)}
            got = {(r.a_pos, r.b_pos, r.rank) for r in knn.knn(v, 9, least, 2000).collect() if r.score >= (least or 0)}
            assert got == want
    monkeypatch.setattr(knn, "_best", lambda d, k: seen.append(d.count()) or of(d, k))
    knn.knn(v, 9, None, 2000).count()
    assert len(seen) == 1 and seen[0] <= 501 * (9 + 8)


def test_bits_bound_what_sets_share(spark):
    rng = random.Random(6)
    sets = [[f"t{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 40, 300]))] for _ in range(60)]
    sets = [sorted(set(x)) for x in sets]
    rows = spark.createDataFrame(list(enumerate(sets)), "pos long, tokens array<string>").mapInArrow(matches._bits, "pos long, n long, " + ", ".join(f"s{k} long" for k in range(matches.LONGS))).collect()
    bits = {r.pos: np.array(r[2:], np.int64) for r in rows}
    assert {r.pos: r.n for r in rows} == {k: len(x) for k, x in enumerate(sets)}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            least = sum(int(z).bit_count() for z in (bits[i] & ~bits[j]).view(np.uint64))
            assert len(set(x) & set(y)) <= len(x) - least and (least or i != j or not x or set(x) <= set(y))
