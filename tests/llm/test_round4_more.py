"""Odd rows through every stage of the pipeline, SQL of the n-gram join, bounds of what is learnt from."""

import random

import numpy as np
import public_tokenizers
import pytest
from test_operators import LONG, ODD, brute_components, docs_of, same_rows, saved
from tokenizers import Tokenizer

from echolode.llm import decontam, langid, ngram_join, packing, secrets, toxicity

ITEM = "a farmer keeps seventeen spotted goats behind the old mill and sells nine of them at the spring market for forty silver coins each"
NAMES = "doc_id long, text string, lang string, source string, n_chars int, key string, row int, rest int, nth int, id long, at binary, score double"


def rows_of(spark, texts, ids=None):
    rows = [(k, t, "en", "src", len(t or ""), "k", 1, 2, 3, 4, b"x", 0.5) for k, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, NAMES)


def tables(spark, tmp_path, docs):
    return saved(
        spark, tmp_path, docs,
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string"),
    )


def test_sql_of_the_join(spark, tmp_path):
    rng, texts = random.Random(5), list(ODD)
    for k in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(40 + 20 * k)]
        texts += [" ".join(base)] * 2
        for _ in range(5):
            w = list(base)
            w[rng.randrange(len(w))] = "Other"
            texts.append(" ".join(w))
    same_rows(ngram_join.query, ngram_join.SQL, spark, tmp_path, documents=docs_of(spark, texts))


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Against plain rules: no labels, so nothing is toxic; one row of near copies, none of those that hold the item, no secret."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(2)
    base = [f"word{rng.randrange(500)}" for _ in range(200)]
    near = " ".join(base[:100] + ["changed"] + base[101:])
    secret = "the config said password = hunter2hunter2 and nothing else of note"
    texts = [*ODD, " ".join(base), near, " ".join(base), f"before it {ITEM} after it", secret, LONG * 2 + "end"]
    ids = [*range(len(texts))]
    docs = rows_of(spark, [*texts, texts[4], None, "no id here", f"no id and {ITEM}"], [*ids, 4, None, None, None])
    got = pipeline.run(spark, tables(spark, tmp_path, docs)).collect()

    named = brute_components(texts, 5, 80)
    stay = [k for k in ids if named[k][1] == k and ITEM not in (texts[k] or "")]
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    want = {k: size(texts[k].replace("password = hunter2hunter2", "[assign]") if texts[k] == secret else texts[k]) for k in stay}
    assert {r.doc_id: r.doc_tokens for r in got if r.doc_id is not None} == want
    assert sum(r.length for r in got) == sum(want.values()) + size(None) + size("no id here")


def test_stages_without_rows_and_with_clashing_names(spark, tmp_path):
    sf = tables(spark, tmp_path, rows_of(spark, ["a b c"]))
    docs = rows_of(spark, [None, "", "one two", ITEM], [1, 2, None, None])
    for module in (toxicity, ngram_join, decontam, secrets):
        assert module.stage(spark, docs.limit(0), sf).count() == 0
        done = module.stage(spark, docs, sf)
        assert done.schema.names == docs.schema.names and done.count() == 4 - (module is decontam)
    assert packing.stage(spark, docs.limit(0), sf).count() == 0


def test_learning_is_bounded_by_bytes(spark):
    docs = rows_of(spark, [f"bad word{k} " * 50 if k % 2 else f"good thing{k} " * 50 for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    whole, none = (toxicity.train(docs, labels, toxicity.FtrlParams(l1=0.1, sample_bytes=n)) for n in (10**9, 0))
    assert len(whole.index) and not len(none.index)


def test_language_rows_in_any_order(spark):
    texts = [f"the {k} cats and the dogs of the house" if k % 2 else f"der {k} hund und die katze im haus" for k in range(60)] + ["...", None, "12", "the" * 40_000]
    rows = [(None if k % 9 == 0 else k, t, "en" if k % 2 else "de") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string, lang string")
    one, two = (langid.train(d) for d in (docs, docs.repartition(7)))
    for level, (names, pairs) in one.levels.items():
        assert names == two.levels[level][0] and all(np.array_equal(w, two.levels[level][1][k]) for k, w in pairs.items())
    got = [(r.lang_pred, r.score) for r in langid.predict(spark, docs.limit(len(texts)), one).collect()]
    assert sum(p == ("en" if k % 2 else "de") for k, (p, _) in enumerate(got[:60])) == 60
    assert [p for p, _ in got[60:]] == ["und", "und", "und", "en"]


def test_far_sets_are_left_early():
    """A set whose rare tokens all differ is ruled out by the beginning of its run, and what is found stays as it was."""
    seen = []

    class Token(int):
        def __hash__(self):
            seen.append(self)
            return int(self)

    run = [Token(t) for t in range(20, 420)]
    tree = ngram_join.Tree(90)
    for other in ([Token(-t) for t in range(60, 0, -1)] + run[60:], run[:-3]):
        tree.add(other, len(other))
    seen.clear()
    assert list(tree.partners(run, len(run), lambda o: False)) == [1]
    assert len(seen) <= 2 * len(run) + 4 * 24 + 10
