"""The data source of source trees against a plain walk, with what it must not open."""

import json
import os

import pytest
from pyspark.sql import functions as F

from echolode.sources import files, tree

INCLUDE, EXCLUDE = ["**/*.py", "**/*.txt"], ["**/venv/**", "deep/no/**", "**/skip.py"]


@pytest.fixture
def top(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("a.py", "b.md", "skip.py", "x/c.py", "x/venv/lib/d.py", "x/y/z/e.txt", "x/y/z/skip.py", "deep/no/f.py", "deep/yes/g.py", "deep/yes/h i é.txt", "venv/j.py", "empty.txt", "other/k.py"):
        path = tmp_path / "t" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(f"# {name}\r\nx\rÿ\n".encode("latin-1") if name != "empty.txt" else b"")
    (tmp_path / "t" / "link.py").symlink_to(tmp_path / "t" / "a.py")
    (tmp_path / "t" / "x" / "loop").symlink_to(tmp_path / "t")
    (tmp_path / "t" / "gone.py").symlink_to(tmp_path / "nothing")
    return tmp_path


@pytest.mark.parametrize("paths", [["t"], ["t/x", "t"], ["t/a.py", "t/deep", "missing"], ["{}/t/a.py", "{}/t/x"], []])
def test_same_as_a_walk(spark, top, paths):
    paths = [p.format(top) for p in paths]
    want = files.read_files(spark, files.listed(paths, INCLUDE, EXCLUDE))
    got = tree.read_tree(spark, paths, INCLUDE, EXCLUDE)
    # of several names of one file either way takes one: what is compared is the file
    told = lambda d: sorted((os.path.realpath(r.path), r.content, r.content_hash, r.language) for r in d.collect())
    # Spark's own reader passes over files without a byte
    assert [x for x in told(got) if x[1]] == told(want) and got.columns == want.columns
    assert any(x[0].endswith("empty.txt") for x in told(got)) == ("t" in paths)
    assert len(told(got)) == len({x[0] for x in told(got)})


def reader(top, paths=("t",), folders=64, kind=tree.TreeReader):
    return kind({"paths": json.dumps(list(paths)), "include": json.dumps(INCLUDE), "exclude": json.dumps(EXCLUDE), "here": str(top), "folders": str(folders)})


def test_excluded_folders_are_never_opened(top, monkeypatch):
    opened, of = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, top)) or of(p))
    for folders in (1, 2, 64):
        opened.clear()
        r = reader(top, folders=folders)
        found = sorted(x[1] for p in r.partitions() for x in r.read(p))
        assert found == sorted(["t/a.py", "t/link.py", "t/empty.txt", "t/x/c.py", "t/x/y/z/e.txt", "t/deep/yes/g.py", "t/deep/yes/h i é.txt", "t/other/k.py"])
        assert not [o for o in opened if "venv" in o or "deep/no" in o or "loop" in o]
    assert len(reader(top, folders=1).partitions()) == 1 < len(reader(top).partitions())


def test_filters_rule_out_folders(spark, top, monkeypatch):
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    opened, of = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, top)) or of(p))
    r = reader(top, kind=tree.FilteredReader)
    filters = [StringStartsWith(("path",), "t/x/y"), IsNotNull(("path",)), EqualTo(("size",), 3)]
    assert list(r.pushFilters(filters)) == filters  # Spark asks them again
    found = {x[1] for p in r.partitions() for x in r.read(p)}
    assert "t/x/y/z/e.txt" in found and not [o for o in opened if o.startswith(("t/deep", "t/other"))]
    monkeypatch.undo()
    os.chdir(top)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = tree.listed_files(spark, ["t"], INCLUDE, EXCLUDE)
        assert {r.path for r in got.where(F.col("path").startswith("t/x/y")).collect()} == {"t/x/y/z/e.txt"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
