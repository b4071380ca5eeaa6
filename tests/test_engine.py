import json
from dataclasses import replace

import pytest

from echolode.cli import merge_globs, preset_globs
from echolode.config import Config, ConfigError, Embedder, Thresholds, Windows, merged, validate
from echolode.functions import syntax
from echolode.functions.columns import covered, lines
from echolode.operators.components import connected_components
from echolode.operators.knn import knn, knn_sql
from echolode.plans import engine, report
from echolode.sources import files

STUB = replace(Config(), embedder=replace(Embedder(), name="stub"))
CODE = "def add(xs):\n    total = 0\n    for x in xs:\n        total += x\n    return total\n"


def test_settings():
    c = validate(merged(Config(), {"windows": {"window_lines": "12"}, "cluster_findings": "yes", "include_globs": "a/*.py"}))
    assert (c.windows.window_lines, c.cluster_findings, c.include_globs) == (12, True, ("a/*.py",))
    for bad in ({"windows": {"window_lines": 0}}, {"thresholds": {"func": 1.5}}, {"engine": "x"}, {"windows": {"stride_lines": True}}, {"windows": 3}):
        with pytest.raises(ConfigError):
            validate(merged(Config(), bad))


def test_globs():
    from pathlib import PurePath

    assert files.matches(["**/*.py"], PurePath("a/b.py")) and files.matches(["**/*.py"], PurePath("b.py"))
    assert files.matches(["src/**/*.py"], PurePath("src/a.js"))
    assert files.matches(["**/venv/**"], PurePath("x/venv/y.py")) and not files.matches(["**/venv/**"], PurePath("x/y.py"))
    assert files.matches(["**/bootstrap/cache/**"], PurePath("bootstrap/cache/sub/x.php")) and files.matches(["**/bootstrap/cache/**"], PurePath("app/bootstrap/cache/y.php"))
    assert not files.matches(["**/bootstrap/cache/**"], PurePath("bootstrap/x.php"))
    assert files.matches(["src/**/*.py"], PurePath("pkg/src/deep/a.js")) and not files.matches(["src/**/*.py"], PurePath("pkg/a.js"))
    assert "**/out/**" in preset_globs(["cpp"])[1]
    assert merge_globs(["a"], ["b"], ["x", "y"], ["x"]) == (["a", "y"], ["b"])
    assert "**/*.rs" in preset_globs(["monorepo"])[0] and preset_globs(["none"]) == ([], [])


def test_syntax():
    found = list(syntax.functions("class A:\n    def f(self):\n        pass\n\ndef g():\n    def h(): pass\n"))
    assert [x[0] for x in found] == ["A.f", "g", "g.h"]
    assert list(syntax.functions("def (")) == []
    assert syntax.normalised('def f():\n    "doc"\n    return 1  # x\n') == "def f():\n    pass\n    return 1"
    assert syntax.normalised("  indented(") == "  indented("


def test_lines_and_covered(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "a\n", "a\n\nb", "a\r\nb\x0bc\x85d\u2028e", "\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lines(F.col("t"))).collect()]
    assert got == [t.splitlines() for t in texts]
    row = spark.createDataFrame([([(1, 3), (2, 5), (6, 7), (10, 11)],)], "s array<struct<s:int,e:int>>")
    assert row.select(covered(F.col("s"))).first()[0] == 9


def test_knn_paths_agree(spark):
    import random

    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 1.0, 2.0]) for _ in range(5)]) for k in range(60)]
    v = spark.createDataFrame(rows, "pos long, vec array<double>")
    as_set = lambda d: {(r.a_pos, r.b_pos, r["rank"]) for r in d.collect()}
    assert as_set(knn(v, 7)) == as_set(knn_sql(v, 7)) == as_set(knn(v, 7, block_bytes=800))
    assert knn(v, 0).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 3)], "src long, dst long")
    assert {tuple(r) for r in connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7)}
    assert connected_components(e.limit(0)).count() == 0


def _scan(spark, tmp_path, texts, c=STUB):
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return engine.scan(spark, [str(tmp_path)], c)


def test_copies_are_found(spark, tmp_path):
    r = _scan(spark, tmp_path, {"a.py": CODE, "b.py": "import os\n\n" + CODE, "c.txt": "x"})
    row = r.findings.collect()[0]
    assert r.stats["file_count"] == 2 and r.stats["function_count"] == 2 and r.stats["finding_count"] == 1
    assert row.score == pytest.approx(1.0) and "func" in row.reasons and row.duplicated_lines == 5
    for kind, writer in report.WRITERS.items():
        writer(r, str(tmp_path / f"out.{kind}"))
    said = json.loads((tmp_path / "out.json").read_text())
    assert said["findings"][0]["compare"]["similarity"] == pytest.approx(1.0)
    assert set(said["timing"]) == {"collect_files", "extract_functions", "generate_snippets", "embed", "similarity"}
    assert len(json.loads((tmp_path / "out.sarif").read_text())["runs"][0]["results"]) == 1
    assert "&harr;" in (tmp_path / "out.html").read_text()


def test_text_units(spark, tmp_path):
    c = replace(STUB, include_globs=("**/*.js", "**/*.ts"), windows=Windows(3, 1, 1), thresholds=Thresholds(win=0.8, lexical_min_ratio=0.0))
    js = "function add(a, b) {\n  return a + b;\n}\n"
    r = _scan(spark, tmp_path, {"a.js": js, "b.ts": js}, c)
    assert r.stats["function_count"] == 0 and r.stats["finding_count"] >= 1


def test_outside_report_defaults(spark, tmp_path):
    from echolode.sources.external import external_findings

    said = {"duplications": [{"a": {"path": "x.py", "start": 4, "code": "c"}, "b": {"path": "y.py", "start": "7", "end": "9", "name": "f"}}, {"a": {"path": "z", "start": 9, "end": 2}, "b": {"path": "w"}}, {"a": {}, "b": {"path": "w"}}, {"a": {"path": "v"}}]}
    (tmp_path / "r.json").write_text(json.dumps(said))
    got = {(r.fn_a, r.fn_b, r.duplicated_lines) for r in external_findings(spark, str(tmp_path / "r.json")).collect()}
    assert got == {("x.py:x.py:4:4", "y.py:f:7:9", 1), ("z:z:9:2", "w:w:1:1", 0)}


def test_matches_hold_the_lexical_floor(spark):
    from echolode.operators import matches

    side = lambda x, n: {f"{x}_pos": n, f"{x}_kind": "WIN", f"{x}_fn_id": f"{x}.py:f:1:9", f"{x}_path": f"{x}.py", f"{x}_fn_start": 1, f"{x}_fn_end": 9, f"{x}_start_line": 1, f"{x}_end_line": 9}
    rows = spark.createDataFrame([side("a", 1) | side("b", 2) | {"cosine": 1.0, "lexical": 0.2, "similarity": 0.95}])
    assert matches.matches(rows).count() == 1 and matches.matches(rows, 0.6).count() == 0


def test_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace

    from echolode.operators.scratch import shared_dir

    told = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    context = lambda master: SimpleNamespace(master=master, getConf=lambda: told)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=told, sparkContext=context("spark://host:7077")))
    assert shared_dir(SimpleNamespace(conf=told, sparkContext=context("local[2]"))).startswith("file://")


def test_empty_scan(spark, tmp_path):
    assert engine.scan(spark, [str(tmp_path)], STUB).stats["finding_count"] == 0


def test_cache(spark, tmp_path):
    c = replace(STUB, cache=replace(STUB.cache, path=str(tmp_path / "cache")))
    (tmp_path / "src").mkdir()
    first = _scan(spark, tmp_path / "src", {"a.py": CODE}, c)
    again = engine.scan(spark, [str(tmp_path / "src")], c)
    assert first.stats["cache_misses"] == 2 and again.stats["cache_hits"] == 2 and again.stats["cache_misses"] == 0
