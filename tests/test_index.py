"""The kept index against a search of all: exact, approximate with its recall, after appends, reading the cells it needs only."""

import random

import pytest
from pyspark.sql import functions as F

from echolode.operators import knn
from echolode.operators.index import VectorIndex


def rows_of(n, seed, centers=12):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(centers)]
    return [(k, [x + rng.gauss(0, 0.08) for x in mid[k % centers]]) for k in range(n)]


def found(d):
    return {(r.a_pos, r.b_pos, r["rank"]) for r in d.collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    # clusters, a vector that half of all rows have, zero and empty ones, nulls
    rows = rows_of(360, 3) + [(1000 + k, [1.0] + [0.0] * 5) for k in range(200)] + [(2000, [0.0] * 6), (2001, []), (2002, None)]
    return spark.createDataFrame(rows, "pos long, vec array<double>").cache()


def test_exact_search_after_appends(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1000)  # cells in slices, asking vectors in groups
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.build(vectors.where("pos % 4 <> 1"), 16)
    index.append(vectors.where("pos % 4 = 1"))
    asks = vectors.where("pos % 5 = 0")
    want = {r for r in found(knn.knn(vectors, 7)) if r[0] % 5 == 0}
    again = VectorIndex(spark, str(tmp_path / "i"))  # another run finds what this one left
    for probes in (1, 5, 40):
        assert found(again.search(asks, 7, probes, exact=True)) == want != set()
    assert again.search(asks.limit(0), 7).count() == 0


def test_recall_and_cells_that_are_read(spark, tmp_path):
    vectors = spark.createDataFrame(rows_of(1200, 8), "pos long, vec array<double>").cache()
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.build(vectors, 24)
    asks = vectors.where("pos % 60 = 0")  # of one cluster, as clusters take turns
    want = {r[:2] for r in found(knn.knn(vectors, 10)) if r[0] % 60 == 0}
    got = {r[:2] for r in found(index.search(asks, 10, 3))}
    assert len(got & want) / len(want) >= 0.9
    cells = [r[0] for r in index.rows().select("cell").distinct().limit(3).collect()]
    some = index.rows(cells)
    assert "PartitionFilters: [cell" in some._jdf.queryExecution().executedPlan().toString()
    files = lambda d: {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files(some)) < len(files(index.rows())) / 3
    assert some.count() < vectors.count() / 3


def test_small_and_missing_indexes(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "pos long, vec array<double>")
    index = VectorIndex(spark, str(tmp_path / "few"))
    with pytest.raises(LookupError):
        index.search(few, 1)
    index.build(few)
    assert found(index.search(few, 5, exact=True)) == found(knn.knn(few, 5))
    index.build(few.limit(0))
    assert index.search(few, 5, exact=True).count() == 0
    index.append(few)
    assert found(index.search(few, 5, exact=True)) == found(knn.knn(few, 5))
    with pytest.raises(ValueError, match="2 components"):
        index.append(spark.createDataFrame([(7, [1.0, 1.0, 1.0])], "pos long, vec array<double>"))
    with pytest.raises(Exception, match="position 7"):
        index.append(spark.createDataFrame([(7, [float("nan"), 1.0])], "pos long, vec array<double>"))
