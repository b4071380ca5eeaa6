"""What a finding covers, against plain sets; reports made by tasks, whole or not there."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from echolode.config import Config, Thresholds
from echolode.operators import matches
from echolode.plans import report
from echolode.plans.engine import ScanResult
from echolode.sources.external import from_pairs

SIDE = "{0}_pos long, {0}_kind string, {0}_fn_id string, {0}_path string, {0}_fn_start int, {0}_fn_end int, {0}_start_line int, {0}_end_line int"


def matched(spark, rows):
    """Rows of (unit a, unit b, span a, span b, kinds, similarity)."""
    out = []
    for k, (a, b, (s, e), (t, u), (x, y), sim) in enumerate(rows):
        out.append((2 * k, x, a, a + ".txt", 1, 999, s, e, 2 * k + 1, y, b, b + ".txt", 1, 999, t, u, sim, 0.8, sim))
    d = spark.createDataFrame(out, f"{SIDE.format('a')}, {SIDE.format('b')}, cosine double, lexical double, similarity double")
    return d.withColumn("kind_rank", matches.kind_rank())


def test_findings_against_sets(spark):
    rng = random.Random(2)
    span = lambda: (s := rng.randrange(1, 90), s + rng.choice([0, 3, 11]))
    rows = [(f"u{rng.randrange(3)}", f"v{rng.randrange(3)}", span(), span(), ("WIN", "WIN"), 0.9 + rng.randrange(99) / 1000) for _ in range(150)]
    rows += [("u0", "v0", (5, 5), (700, 701), ("FUNC", "FUNC"), 0.99), ("w", "z", (9, 3), (4, 4), ("WIN", "WIN"), 0.95)]
    found = matched(spark, rows)
    groups, by = matches.findings(found, Thresholds()), defaultdict(list)
    for r in rows:
        by[r[0], r[1]].append(r)
    got = {(r.fn_a, r.fn_b): r for r in groups.collect()}
    assert set(got) == set(by)
    for pair, own in by.items():
        r = got[pair]
        assert r.n_evidence == len(own) and r.score == max(x[5] for x in own)
        lines = [{k for x in own for k in range(x[i][0], x[i][1] + 1)} for i in (2, 3)]
        assert r.duplicated_lines == min(map(len, lines))
        for x, told in zip("ab", lines, strict=True):
            start, end = r.best[f"{x}_start"], r.best[f"{x}_end"]
            assert (r[f"before_{x}"], r[f"after_{x}"]) == (sum(k < start for k in told), sum(k > end for k in told))
            assert (r[f"first_{x}"], r[f"last_{x}"]) == (min(s for y in own for s in (y[2 if x == "a" else 3][0],)), max(y[2 if x == "a" else 3][1] for y in own))
    told = matches.evidence(found, groups).collect()
    assert len(told) == len(rows) and [(r.fn_a, r.fn_b, r.a_start) for r in told] == sorted((r.fn_a, r.fn_b, r.a_start) for r in told)


def test_a_large_group_is_no_one_value(spark):
    """Two units with 40,000 matches: nothing of the plan gathers them in one value."""
    d = spark.range(40_000).select(F.expr("cast(id % 20000 * 6 + 1 as int) as s"), F.expr("cast(id * 7 % 20000 * 6 + 1 as int) as t"))
    sides = lambda x, s: [F.lit(1).cast("long").alias(f"{x}_pos"), F.lit("WIN").alias(f"{x}_kind"), F.lit(x).alias(f"{x}_fn_id"), F.lit(x).alias(f"{x}_path"), F.lit(1).alias(f"{x}_fn_start"), F.lit(9).alias(f"{x}_fn_end"), F.col(s).alias(f"{x}_start_line"), (F.col(s) + 11).alias(f"{x}_end_line")]
    found = d.select(*sides("a", "s"), *sides("b", "t"), F.lit(0.95).alias("similarity"), F.lit(0.95).alias("cosine"), F.lit(0.9).alias("lexical"), F.lit(1).alias("kind_rank"))
    groups = matches.findings(found)
    r = groups.first()
    assert (r.n_evidence, r.duplicated_lines, r.first_a, r.last_a) == (40_000, 19_999 * 6 + 12, 1, 19_999 * 6 + 12)
    assert "collect_" not in groups._jdf.queryExecution().executedPlan().toString()
    assert matches.evidence(found, groups).count() == 40_000


PAIRS = "a struct<path:string,start:string,end:string,code:string,name:string>, b struct<path:string,start:string,end:string,code:string,name:string>"


def outside(spark, n):
    rows = [((f"p{k % 7:03d}é", "1", "9", "", "n\n<x>"), (f"q{k:03d}", "2", "5", "", None)) for k in range(n)]
    return ScanResult(from_pairs(spark.createDataFrame(rows + rows[:2], PAIRS).repartition(5)), None, {"finding_count": n + 2}, Config())


def test_reports_are_whole_files(spark, tmp_path):
    """A repeated pair, names that need escapes, several parts, no finding at all."""
    for n in (60, 0):
        result = outside(spark, n) if n else ScanResult(outside(spark, 3).findings.limit(0), None, {"finding_count": 0}, Config())
        for kind, write in report.WRITERS.items():
            write(result, str(tmp_path / f"r.{kind}"))
            write(result, str(tmp_path / f"r.{kind}"))  # a report that is there is replaced
        said = json.loads((tmp_path / "r.json").read_text("utf-8"))
        names = [(f["function_a"]["path"], f["function_b"]["path"]) for f in said["findings"]]
        assert len(names) == (n + 2 if n else 0) and names == sorted(names) and said["stats"] == result.stats and said["schema_version"] == report.SCHEMA_VERSION
        results = json.loads((tmp_path / "r.sarif").read_text("utf-8"))["runs"][0]["results"]
        assert [tuple(x["physicalLocation"]["artifactLocation"]["uri"] for x in r["locations"]) for r in results] == names
        page = (tmp_path / "r.html").read_text("utf-8")
        assert page.count("<section") == len(names) and page.endswith("</main>") and "<x>" not in page
        assert sorted(p.name for p in tmp_path.iterdir()) == ["r.html", "r.json", "r.sarif"]


def test_a_task_that_fails_leaves_no_report(spark, tmp_path, monkeypatch):
    def fail(r):
        raise ValueError("lost")

    monkeypatch.setattr(report, "section", fail)
    (tmp_path / "old.html").write_text("old")
    for name in ("new.html", "old.html"):
        with pytest.raises(Exception, match="lost"):
            report.write_html(outside(spark, 20), str(tmp_path / name))
    assert [p.name for p in tmp_path.iterdir()] == ["old.html"] and (tmp_path / "old.html").read_text() == "old"
