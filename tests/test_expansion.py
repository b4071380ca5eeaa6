from dataclasses import replace

from pyspark.sql import functions as F

from echolode import cli
from echolode.config import Expansion, Thresholds
from echolode.functions import calls
from echolode.operators.expansion import call_snippets
from echolode.operators.snippets import function_units
from echolode.plans import catalog, engine
from test_engine import CODE, STUB

TREE = {
    "pkg/main.py": """import tools
import lib.deep as deep
from shapes import Box, Box as Crate
from tools import mean as average, nothing

def here(x):
    return mid(x)

def mid(x):
    return low(x)

def low(x):
    return x

def by_name(x):
    return average(x)

def by_module(x):
    return tools.mean(x) + deep.dig(x)

def by_instance(x):
    a = Box()
    b = a
    return b.area(x)

def by_annotation(x):
    a: Crate = x
    return a.area(1)

def by_constructor(x):
    return Box().area(x)

def by_factory(x):
    a = tools.make()
    return a.run()

def alone(x):
    return print(x) or nothing(x) or nowhere.at(x)
""",
    "pkg/tools.py": "def mean(x):\n    return sum(x)\n\ndef make():\n    return Tool()\n\nclass Tool:\n    def run(self):\n        return 1\n",
    "pkg/shapes.py": "class Box:\n    def area(self, x):\n        return x\n",
    "other/lib/deep/__init__.py": "def dig(x):\n    return x\n",
    "pkg/broken.py": "def (",
}
EXPECTED = {"here": ["mid"], "mid": ["low"], "by_name": ["mean"], "by_module": ["mean", "dig"], "by_instance": ["Box.area"], "by_annotation": ["Box.area"], "by_constructor": ["Box.area"], "by_factory": ["make", "Tool.run"]}


def _expanded(spark, tree, **params):
    files = spark.createDataFrame([(p, t, "", "python") for p, t in tree.items()], "path string, content string, content_hash string, language string")
    rows = call_snippets(files, function_units(files), Expansion(enabled=True, **params), normalise=False).collect()
    return {r.fn_id.split(":")[1]: [x.split("\n")[0] for x in r.text.split("\n\n# expanded:")[1:]] for r in rows}


def test_calls_are_resolved(spark):
    got = _expanded(spark, TREE, max_chars=10_000)
    assert got == EXPECTED


def test_depth_and_size(spark):
    small = {"a.py": TREE["pkg/main.py"]}
    assert _expanded(spark, small, depth=2, max_chars=10_000)["here"] == ["mid", "low"]
    assert _expanded(spark, small, depth=9, max_chars=10_000)["here"] == ["mid", "low"]
    assert _expanded(spark, TREE, max_chars=1) == {} == _expanded(spark, {}, depth=1) == _expanded(spark, TREE, depth=0)
    # one that is too long is passed over, a shorter one after it is not
    tree = {"a.py": "def f():\n    big()\n    ok()\n\ndef big():\n    return '" + "x" * 500 + "'\n\ndef ok():\n    return 1\n"}
    assert _expanded(spark, tree, max_chars=200) == {"f": ["ok"]}
    # a function that calls itself and one that is called twice
    assert _expanded(spark, {"a.py": "def f(n):\n    return f(n) + g() + g()\n\ndef g():\n    return f(1)\n"}, depth=3) == {"f": ["g"], "g": ["f"]}


def test_facts():
    told, binds, made = calls.facts("def f():\n    a = b = C()\n    a.go(g(1))\n    C().x()\n    return D(1)\n")
    assert told == [("name", None, "C"), ("attr", "a", "go"), ("name", None, "g"), ("ctor", "C", "x"), ("name", None, "D")]
    assert binds == [("a", "made", None, "C"), ("b", "made", None, "C")] and made == "D"
    assert calls.facts("    def m(self):\n        self.x()\n") == ([], [], None)
    assert [x[:3] for x in calls.imports("p/q/a.py", "from .b import *\nfrom . import c\nfrom .d import e as f\nimport g.h\n")] == [("f", "e", "d"), ("h", None, "g/h")]


def test_scan_with_expansion(spark, tmp_path):
    # the functions differ, so that only their expansions are over their threshold
    for name, var in (("a", "xs"), ("b", "ys")):
        (tmp_path / f"{name}.py").write_text(CODE + f"\n\ndef of_{name}({var}):\n    return add({var})\n")
    c = replace(STUB, expansion=Expansion(enabled=True), thresholds=Thresholds(func=0.9, exp=0.5, win=0.9, lexical_min_ratio=0.0, lexical_weight=1.0))
    with_exp, without = (engine.scan(spark, [str(tmp_path)], x) for x in (c, replace(c, expansion=Expansion())))
    assert with_exp.stats["snippet_count"] == without.stats["snippet_count"] + 2
    reasons = lambda r: {(x.fn_a.split(":")[1], x.fn_b.split(":")[1]): list(x.reasons) for x in r.findings.collect()}
    assert reasons(with_exp)["of_a", "of_b"] == ["exp"] and ("of_a", "of_b") not in reasons(without)


def test_options():
    told = lambda *a: cli.overrides(cli.parser().parse_args(["scan", *a])).get("expansion")
    assert told() is None and told("--expand-calls") == {"enabled": True}
    assert told("--expand-depth", "0") == {"enabled": True, "depth": 0} and told("--expand-max-chars", "9") == {"enabled": True, "max_chars": 9}


def test_small_keys_are_dealt_out(spark, tmp_path):
    spark.range(40).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = catalog._projects(spark, str(tmp_path))
    parts = files.select(F.spark_partition_id().alias("p"), "path").distinct()
    assert parts.count() == 160 and parts.select("p").distinct().count() >= spark.sparkContext.defaultParallelism
