"""Functions of SQL against those that they stand for."""

import pytest

from echolode.functions import calls, sql, syntax
from echolode.functions.columns import jaccard, tokens
from echolode.operators.snippets import text_units, window_snippets
from echolode.config import Windows

SOURCE = 'def f(x):\n    "doc"\n    g(x)\n    x.h()\n    return C().k(g(1))\n\nclass A:\n    def m(self):\n        return 1\n'


def test_table_functions(spark):
    sql.register(spark)
    sql.register(spark)
    files = spark.createDataFrame([("a", SOURCE), ("b", "def ("), ("c", None), ("d", "")], "path string, content string")
    got = spark.sql("SELECT path, f.* FROM {files}, LATERAL source_functions(content) f", files=files).collect()
    assert [(r.path, r.ord, r.qualified_name, r.start_line, r.end_line, r.code) for r in got] == [("a", k, *f) for k, f in enumerate(syntax.functions(SOURCE))]
    got = spark.sql("SELECT c.* FROM {files}, LATERAL source_calls(content) c WHERE path = 'a' ORDER BY place", files=files).collect()
    assert [tuple(r)[1:] for r in got] == calls.facts(SOURCE)[0]


def test_line_windows_are_those_of_the_engine(spark):
    sql.register(spark)
    texts = ["a\nb\n\n \nc\nd\ne", "", None, "\n\n", "x", "a\r\nb\x0bc\x85d\u2028e", "\n".join(map(str, range(30)))]
    files = spark.createDataFrame([(f"p{k}", t, "", "text") for k, t in enumerate(texts)], "path string, content string, content_hash string, language string")
    for params in (Windows(4, 2, 2), Windows(3, 5, 1)):
        want = {(r.path, r.start_line, r.end_line, r.text) for r in window_snippets(text_units(files), params, normalise=False).collect()}
        got = spark.sql(f"SELECT path, w.at + 1, w.rel, w.raw FROM {{files}}, LATERAL line_windows(content, {params.window_lines}, {params.stride_lines}, {params.min_nonempty}) w", files=files).collect()
        assert {tuple(r) for r in got} == want != set()
    with pytest.raises(Exception, match="must be positive"):
        spark.sql("SELECT * FROM line_windows('a', 0, 1, 1)").collect()


def test_scalar_functions(spark):
    sql.register(spark)
    d = spark.createDataFrame([("The cat_1 the", "a cat_1"), ("", "x"), (None, "x"), ("é!", "é!")], "a string, b string")
    got = spark.sql("SELECT tokens(a) AS t, jaccard(tokens(a), tokens(b)) AS j, normalised(a) AS n FROM {d}", d=d).collect()
    want = d.select(tokens(d.a).alias("t"), jaccard(tokens(d.a), tokens(d.b)).alias("j")).collect()
    assert [(r.t, r.j) for r in got] == [(r.t, r.j) for r in want] and got[0].t == ["cat_1", "the"]
