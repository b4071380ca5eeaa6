"""Windows, tokens and what is compared of token sets: in one pass each, as the expressions have them."""

import random

from pyspark.sql import functions as F

from echolode.config import Thresholds, Windows
from echolode.functions import columns as C
from echolode.functions import syntax
from echolode.operators import matches, overlap, snippets

ODD = ["", "a", "a\n", "\n\n", "a\r\nb\x0bc\x1cd\x85e f\n", "\x1f\n　 \nx\ny\nz\n", "KK İX A_1-b2\x00c", "Straße ÀB cd", None]


def test_tokens_and_windows_as_by_expressions(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab Z_9\n\n\t\r\x0c é") for _ in range(200)) for _ in range(60)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string")
    for r in d.select("text", C.tokens(F.col("text")).alias("want"), snippets.tokens("text").alias("got")).collect():
        assert r.got == r.want
    files = d.where("text is not null").select(F.concat(F.lit("d/"), "k").alias("path"), F.col("text").alias("content"), F.lit("text").alias("language"))
    units = snippets.text_units(files)
    assert all(r.n == r.end_line for r in units.select(F.size(C.lines(F.col("code"))).alias("n"), "end_line").collect())
    got = sorted((r.path, r.start_line, r.end_line, r.text) for r in snippets.window_snippets(units, Windows(4, 3, 2), normalise=False).collect())
    want = []
    for r in files.where(F.col("content").rlike(C.INK)).select("path", C.lines(F.col("content")).alias("lines"), F.transform(C.lines(F.col("content")), lambda x: x.rlike(C.INK)).alias("ink")).collect():
        want += [(r.path, at + 1, min(at + 4, len(r.lines)), "\n".join(r.lines[at : at + 4])) for at in range(0, len(r.lines), 3) if sum(r.ink[at : at + 4]) >= 2]
    assert got == sorted(want) and len(got) > 200


def test_windows_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(snippets, "OUT_CHARS", 50)
    text = "\n".join(f"line {k}" for k in range(300))
    files = spark.createDataFrame([("p", text, "text"), ("q", "x", "text")], "path string, content string, language string")
    got = snippets.window_snippets(snippets.text_units(files), Windows(6, 2, 1), normalise=False)
    assert got.count() == 151 and got.where("path = 'q'").count() == 1


def test_equal_sets_need_no_tokens(spark):
    """Candidates of copies were joined with the tokens of all rows; now only pairs of different sets are."""
    side = ["WIN", "f", "p", 1, 9, 1, 9]
    sets = [["a", "b", "c"]] * 3 + [["a", "b", "d"], [], []]
    s = spark.createDataFrame([(k, *side, f"h{k}", t) for k, t in enumerate(sets)], "pos long, kind string, fn_id string, path string, fn_start int, fn_end int, start_line int, end_line int, snippet_hash string, tokens array<string>")
    near = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (4, 5, 1.0)], "a_pos long, b_pos long, score double")
    narrow = matches.bits(s)
    blind = s.withColumn("tokens", F.when(F.col("pos").isin(2, 3), F.col("tokens")))
    t = Thresholds(lexical_min_ratio=0.0, win=0.5)
    got = sorted((r.a_pos, r.b_pos, r.lexical) for r in matches.candidates(blind, near, t, narrow).collect())
    assert got == [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.5), (4, 5, 0.0)]


def test_first_tokens_are_the_rarest(spark):
    sets = [sorted({"the", "of", f"x{k % 40}", f"y{k}"}) for k in range(80)]
    s = spark.createDataFrame([(k, t) for k, t in enumerate(sets)], "pos long, tokens array<string>")
    code = lambda x: matches.zlib.crc32(x.encode())
    for r in overlap.sketches(s).collect():
        assert list(matches.np.frombuffer(r.first, matches.np.uint32)) == [code(f"y{r.pos}"), code(f"x{r.pos % 40}")]
    assert syntax.tokens("B a b") == [b"a", b"b"]


def test_answers_through_a_state(spark, tmp_path, monkeypatch):
    """The same candidates as by a search of all, with a state of only those that ask; what it has asks new rows only."""
    from echolode.operators import incremental, knn
    from echolode.operators.snapshots import Store

    rng, t = random.Random(9), Thresholds()
    least, words = (0.9 - t.lexical_weight) / (1 - t.lexical_weight), [f"w{k}" for k in range(300)]
    texts = [([rng.random() for _ in range(4)], rng.sample(words, 12)) for _ in range(60)]
    schema = "pos long, vec array<double>, tokens array<string>, kind string, fn_id string, path string, fn_start int, fn_end int, start_line int, end_line int, snippet_hash string, text_hash string"

    def rows(keep):
        out = []
        for k in range(400):
            vec, tokens = texts[k % 60]
            own = random.Random(k)
            if k % 3:
                vec = [x + own.uniform(-0.05, 0.05) for x in vec]
            if k % 4:
                tokens = [*tokens[1:], f"n{k % 5}"]
            if keep(k):
                out.append((len(out), vec, sorted(set(tokens)), "WIN", f"f{k:03}", f"p{k:03}", 1, 9, 1, 9, f"h{k}", f"t{k}"))
        return spark.createDataFrame(out, schema).cache()

    for k in (3,):
        store, asked, of = Store(spark, f"{tmp_path}/state{k}"), [], knn.ask
        monkeypatch.setattr(overlap.knn, "ask", lambda d, *a, of=of, **b: asked.append((d.count(), d.where("asks").count())) or of(d, *a, **b))
        for keep in (lambda k: k % 7 != 2, lambda k: k % 19 != 3, lambda k: k % 19 != 3):
            s = rows(keep)
            near = overlap.near(s, k, least, t, answer=incremental.through(store, s, k, least, {"k": k}))
            found = lambda near: sorted((r.a_pos, r.b_pos, r.similarity) for r in matches.candidates(s, near, t).collect())
            got = found(near)
            assert got == found(knn.knn(s.select("pos", "vec"), k, least)) and len(got) > 50
        assert asked[-2][1] == 0  # nothing changed: none is held against all
        monkeypatch.setattr(overlap.knn, "ask", of)
