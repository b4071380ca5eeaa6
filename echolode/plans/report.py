"""Reports of a scan: JSON, SARIF and HTML."""

from __future__ import annotations

import difflib
import html
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..operators.scratch import Scratch
from .engine import ScanResult

#: reports change with the package
SCHEMA_VERSION = __version__


def _texts(result: ScanResult) -> DataFrame:
    """Findings, with the texts of the best match beside them."""
    d = result.findings
    if result.snippets is not None and "best" in d.columns:
        text: DataFrame = result.snippets.select("pos", "text")
        a, b = (text.select(F.col("pos").alias(f"_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
        d = d.join(a, F.col("best.a_pos") == a["_a"], "left").join(b, F.col("best.b_pos") == b["_b"], "left").drop("_a", "_b")
    return d


def _write(rows: DataFrame, said: Callable[[dict], str], order: list[Column | str], head: str, tail: str, out: str, between: str = "") -> None:
    """One file: ``head``, what ``said`` makes of each row, in order, with ``between`` between two of them, and ``tail``.

    Tasks make the rows' texts, and Spark's own writer commits those of whole tasks only. The driver puts the parts one after the
    other as bytes, holding none of them, and gives the file its name when it is whole; so a job that fails leaves no report."""
    spark = rows.sparkSession
    scratch = Scratch(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([between + said(r) for r in b.to_pylist()], pa.string())], names=["value"])

    lines = rows.orderBy(*order).mapInArrow(run, "value string")
    lines.write.text(f"{scratch.root}/report")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p if "://" in p else os.path.abspath(p))
    final, draft = path(out), path(f"{out}.{uuid.uuid4().hex}.tmp")
    fs, parts = final.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/report")
    fs.setWriteChecksum(False)  # no file beside it
    stream, at, first = fs.create(draft, True), parts.getFileSystem(conf), bool(between)
    try:
        stream.write(bytearray(head.encode()))
        for part in sorted((s.getPath() for s in at.listStatus(parts) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            source = at.open(part)
            if first:
                first = source.skip(len(between)) < len(between)  # nothing stands before the first row
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 16, False)
            source.close()
        stream.write(bytearray(tail.encode()))
        stream.close()
        fs.delete(final, False)
        fs.rename(draft, final)
    except BaseException:
        fs.delete(draft, False)
        raise
    finally:
        scratch.drop("report")


def unit(fn_id: str) -> dict:
    path, name, start, end = fn_id.rsplit(":", 3)
    return {"path": path, "qualified_name": name, "start_line": int(start), "end_line": int(end)}


def diff_text(a: str, b: str, most_lines: int = 80, most_chars: int = 4000) -> str:
    lines = list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "a", "b", lineterm="", n=3))
    out = "\n".join(lines[:most_lines])[:most_chars]
    return out if len(lines) <= most_lines and len("\n".join(lines)) <= most_chars else out + "\n... (truncated)"


def _finding(r: dict) -> dict:
    best = r.get("best")
    compare = None
    if best:
        compare = {
            "kind_a": best["a_kind"],
            "kind_b": best["b_kind"],
            "span_a": {"start": best["a_start"], "end": best["a_end"]},
            "span_b": {"start": best["b_start"], "end": best["b_end"]},
            "similarity": best["similarity"],
            "evidence": f"{best['a_pos']}->{best['b_pos']}|emb={best['cosine']:.3f}|lex={best['lexical']:.3f}|comp={best['similarity']:.3f}",
            "diff": diff_text(r.get("text_a"), r.get("text_b")),
        }
    meta = {"cluster_id": str(r["cluster"])} if "cluster" in r else {}
    return {"function_a": unit(r["fn_a"]), "function_b": unit(r["fn_b"]), "score": r["score"], "duplicated_lines": r["duplicated_lines"], "reasons": r["reasons"], "metadata": meta, "compare": compare}


BY_NAME = ("fn_a", "fn_b")


def write_json(result: ScanResult, out: str) -> None:
    rest = json.dumps({"stats": result.stats, "config": asdict(result.config), "timing": result.timing}, indent=2)
    head = f'{{\n  "schema_version": {json.dumps(SCHEMA_VERSION)},\n  "findings": [\n'
    _write(_texts(result), lambda r: json.dumps(_finding(r)), list(BY_NAME), head, f"  ],\n{rest[2:]}", out, ",")


def write_sarif(result: ScanResult, out: str) -> None:
    def place(fn_id: str) -> dict:
        u = unit(fn_id)
        return {"physicalLocation": {"artifactLocation": {"uri": u["path"]}, "region": {"startLine": u["start_line"], "endLine": u["end_line"]}}}

    rule = {"id": "duplicate-code", "shortDescription": {"text": "Duplicated code"}}

    def row(r: dict) -> str:
        f = _finding(r)
        return json.dumps({"ruleId": rule["id"], "level": "note", "message": {"text": f"{r['fn_a']} and {r['fn_b']} are alike"}, "locations": [place(r["fn_a"]), place(r["fn_b"])], "properties": {k: f[k] for k in ("score", "duplicated_lines", "reasons", "metadata")}})

    tool = json.dumps({"driver": {"name": "echolode", "version": SCHEMA_VERSION, "rules": [rule]}})
    head = f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {tool}, "results": [\n'
    _write(_texts(result), row, list(BY_NAME), head, "]}]}\n", out, ",")


def side_by_side(a: str, b: str) -> str:
    """Table rows of two texts without blank lines, equal and changed lines beside each other."""
    x, y = ([s for s in (t or "").splitlines() if s.strip()] for t in (a, b))
    rows = []
    for tag, i0, i1, j0, j1 in difflib.SequenceMatcher(None, x, y).get_opcodes():
        for k in range(max(i1 - i0, j1 - j0)):
            left, right = (x[i0 + k] if i0 + k < i1 else "", y[j0 + k] if j0 + k < j1 else "")
            rows.append(f'<tr class="{tag}"><td>{html.escape(left)}</td><td>{html.escape(right)}</td></tr>')
    return "".join(rows)


def section(r: dict) -> str:
    """A finding as HTML, with the lines that its best match doesn't show as counts."""
    said, shown = "", ""
    if r.get("best"):
        note = lambda n, m: f'<tr class="hidden"><td>{n} lines not shown</td><td>{m} lines not shown</td></tr>' if n or m else ""
        shown = f"<table>{note(r['before_a'], r['before_b'])}{side_by_side(r.get('text_a'), r.get('text_b'))}{note(r['after_a'], r['after_b'])}</table>"
        said = f"<p>lines {r['first_a']}-{r['last_a']}; {r['first_b']}-{r['last_b']}</p>"
    return f'<section data-lines="{r["duplicated_lines"]}" data-score="{r["score"]}" data-path="{html.escape(r["path_a"])}"><h2>{html.escape(r["fn_a"])} &harr; {html.escape(r["fn_b"])}</h2><p>score {r["score"]:.3f}, {r["duplicated_lines"]} lines, {", ".join(r["reasons"])}</p>{said}{shown}</section>'


def write_html(result: ScanResult, out: str) -> None:
    script = "const s=k=>{const m=document.querySelector('main');[...m.children].sort((a,b)=>k=='path'?a.dataset.path.localeCompare(b.dataset.path):b.dataset[k]-a.dataset[k]).forEach(x=>m.append(x))}"
    buttons = "".join(f"<button onclick=\"s('{k}')\">{k}</button>" for k in ("lines", "score", "path"))
    head = f"<!doctype html><meta charset='utf-8'><title>Duplicates</title><style>table{{font:12px monospace;white-space:pre}}.replace,.insert,.delete{{background:#ffd}}</style><script>{script}</script>{buttons}<main>"
    _write(_texts(result), section, [F.desc("duplicated_lines"), F.desc("score"), F.col("fn_a"), F.col("fn_b")], head, "</main>", out)


WRITERS = {"json": write_json, "sarif": write_sarif, "html": write_html}
