"""Windows by the bytes of many texts at once, against the plain form; token pairs that can't pass."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolode.config import Thresholds, Windows
from echolode.functions import columns as C
from echolode.functions import cut, syntax
from echolode.operators import overlap, snippets

ODD = ["", "a", "a\n", "\n\n", "a\r\nb\x0bc\x1cd\x85e f\n", "\x1f\n　 \nx\ny\nz\n", "KK İX A_1-b2\x00c\nabcdefghijk abcdefghijklmnopqrst", "Straße ÀB cd\n\n\nKK", None]


@pytest.mark.parametrize("params", [Windows(4, 3, 2), Windows(5, 7, 0), Windows(2, 1, 1)])
def test_told_windows(spark, monkeypatch, params):
    monkeypatch.setattr(cut, "TEXT_BYTES", 700)
    monkeypatch.setattr(cut, "TOKENS", 60)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab Z_9\n\n\t\r\x0c é K\xa0—") for _ in range(200)) for _ in range(60)]
    files = spark.createDataFrame([(f"d/{k}", x or "", "text") for k, x in enumerate(texts)], "path string, content string, language string")
    w = snippets.window_snippets(snippets.text_units(files), params, normalise=False).withColumn("digest", F.unhex(F.sha2("text", 256)))
    told, same = snippets.told_windows(files, params), ["kind", "fn_id", "path", "fn_start", "fn_end", "start_line", "end_line", "snippet_hash", "digest"]
    assert sorted(map(tuple, told.select(*same).collect())) == sorted(map(tuple, w.select(*same).collect()))
    sets = {r.snippet_hash: tuple(syntax.tokens(r.text)) for r in w.collect()}
    alike = {}
    for r in told.collect():
        assert alike.setdefault(sets[r.snippet_hash], r.set) == r.set
        assert len(set(np.frombuffer(r.codes, np.uint32).tolist())) == len(sets[r.snippet_hash])
    assert len(set(alike.values())) == len(alike) > 50


def test_vectors_by_digest(spark):
    import pyarrow as pa

    texts = ["", "a", "b\nc"]
    got = snippets.digest_vectors(pa.record_batch({"digest": [hashlib.sha256(x.encode()).digest() for x in texts]})).to_pylist()
    want = [r.v for r in spark.createDataFrame([(x,) for x in texts], "t string").select(C.hash_vector(F.col("t")).alias("v")).collect()]
    assert np.allclose(got, want, rtol=0, atol=1e-15)


def test_pairs_without_room_for_enough_tokens_are_left_out():
    """Sets of ten whose first shared token is the third: at most 8 of 12 are shared, which a cosine of 0.95 doesn't make up for; one of 1 does."""
    t = Thresholds()
    for many in (2, 60):  # by steps and as matrices
        for cosine, passes in ((0.95, False), (1.0, True)):
            e = np.zeros(many, overlap._entry(2))
            e["token"], e["ent"], e["n"], e["rest"], e["floor"] = 7, np.arange(many), 10, 8, 0.9
            e["q"] = [(32767, 0)] + [(round(cosine * 32767), round((1 - cosine**2) ** 0.5 * 32767))] * (many - 1)
            got = overlap.meet(e, overlap.needed(t) - 1e-9, t)
            assert ((got["a"] == 0).sum() == many - 1) == passes and ((got["a"] == 0).sum() == 0) != passes
