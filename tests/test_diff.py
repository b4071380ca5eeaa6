"""Changed files by git, diffs from end to end, with and without a remembered state, caches of several kinds."""

import json
import subprocess
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from echolode import cli
from echolode.config import PRESETS, Cache, Config, Thresholds, Windows
from echolode.operators import embed
from echolode.plans import engine
from echolode.sources import changes

CONFIG = Config(embedder=PRESETS["stub"], windows=Windows(6, 3, 2), thresholds=Thresholds(lexical_min_ratio=0.1), include_globs=("**/*.py", "**/*.txt"))


def code(n, name="f"):
    return f"def {name}{n}(xs):\n    acc = {n}\n    for x in xs:\n        acc += x * {n}\n        acc -= {n}\n    return acc\n"


def git(*args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    git("init", "-q")
    (tmp_path / "src").mkdir()
    for k in range(6):
        (tmp_path / "src" / f"m{k}.py").write_text(code(k % 3) + "\n" + code(k, "g"))
    (tmp_path / ".gitignore").write_text("ignored.py\n")
    git("add", ".")
    git("commit", "-qm", "first")
    return tmp_path


def test_changed_files(tree):
    assert changes.changed_files() == []
    (tree / "src" / "m0.py").write_text(code(9))
    (tree / "src" / "new file.py").write_text(code(1))
    (tree / "ignored.py").write_text(code(1))
    (tree / "src" / "m1.py").unlink()
    assert changes.changed_files() == ["src/m0.py", "src/m1.py", "src/new file.py"]
    assert changes.changed_files("HEAD", ["src/m0.py"]) == ["src/m0.py"]
    git("add", ".")
    git("commit", "-qm", "second")
    assert changes.changed_files() == [] and len(changes.changed_files("HEAD~1")) == 3
    with pytest.raises(changes.GitError):
        changes.changed_files("no-such-base")
    assert changes.shown("./a.py") == "a.py" == changes.shown(str(tree / "a.py"))


def found(result):
    return {(r.fn_a, r.fn_b, round(r.score, 9), r.duplicated_lines, tuple(r.reasons)) for r in result.findings.collect()}


def test_diff_with_and_without_state(spark, tree):
    state = str(tree / ".state")
    assert engine.diff(spark, "HEAD", ["src"], CONFIG).stats["finding_count"] == 0  # nothing changed
    whole = engine.scan(spark, ["src"], CONFIG, state)
    assert whole.stats["finding_count"] > 3
    (tree / "src" / "m1.py").write_text(code(0) + "\n" + code(7, "h"))
    (tree / "src" / "m7.py").write_text(code(7, "h"))
    (tree / "src" / "m5.py").unlink()
    # a scan of all, limited afterwards, has the same
    touched = {"src/m1.py", "src/m7.py", "src/m5.py"}
    want = {r for r in found(engine.scan(spark, ["src"], CONFIG)) if touched & {r[0].split(":")[0], r[1].split(":")[0]}}
    plain = engine.diff(spark, "HEAD", ["src"], CONFIG)
    assert found(plain) == want != set() and plain.stats["file_count"] == 6
    quick = engine.diff(spark, "HEAD", ["src"], CONFIG, state)
    assert found(quick) == want and plain.stats == quick.stats
    clustered = replace(CONFIG, cluster_findings=True)
    assert {r[:2] for r in found(engine.diff(spark, "HEAD", ["src"], clustered, state))} == {r[:2] for r in found(engine.diff(spark, "HEAD", ["src"], clustered))}


def test_diff_command(spark, tree):
    (tree / "src" / "m1.py").write_text(code(0))
    (tree / "pyproject.toml").write_text("")
    result = cli.run(spark, ["diff", "--embedder", "stub", "--format", "json", "--out", "r.json", "--state", "kept", "src"])
    said = json.loads((tree / "r.json").read_text())
    assert result.stats["finding_count"] == len(said["findings"]) > 0 and (tree / "kept").is_dir()


def test_config_root(tmp_path, monkeypatch):
    for name in ("a", "b"):
        (tmp_path / name / "src").mkdir(parents=True)
        (tmp_path / name / "pyproject.toml").write_text("")
    (tmp_path / "c").mkdir()
    assert cli.config_root([str(tmp_path / "a" / "src")]) == tmp_path / "a"
    assert cli.config_root([str(tmp_path / "a"), str(tmp_path / "a" / "src")]) == tmp_path / "a"
    assert cli.config_root([str(tmp_path / "a" / "src"), str(tmp_path / "b" / "src")]) == tmp_path
    assert cli.config_root([str(tmp_path / "c"), str(tmp_path / "a")]) == tmp_path
    (tmp_path / "a" / "src" / "x.py").write_text("")
    monkeypatch.chdir(tmp_path / "b" / "src")
    assert cli.config_root([]) == tmp_path / "b" and cli.config_root([str(tmp_path / "a" / "src" / "x.py")]) == tmp_path / "a"


def texts_of(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def cached(d):
    return {r.text: (r.cached, tuple(r.vec)) for r in d.collect()}


def test_cache_takes_older_files(spark, tmp_path):
    """A JSON file for each key, as older caches had; broken ones, and those of no wanted key, are left alone."""
    e, folder = PRESETS["stub"], tmp_path / "cache"
    folder.mkdir()
    keys = {r.text: r.key for r in texts_of(spark, "a", "b", "c", "d", "e").withColumn("key", embed.cache_key("text", e)).collect()}
    (folder / f"{keys['a']}.json").write_text(json.dumps({"vector": [1, 0.5], "dim": 2}))
    (folder / f"{keys['b']}.json").write_text('{"vector": [1, 0')
    (folder / f"{keys['c']}.json").write_text(json.dumps({"vector": "no", "dim": 2}))
    (folder / f"{keys['d']}.json").write_text(json.dumps({"vector": [1.0, None], "dim": 2}))
    (folder / "other.json").write_text(json.dumps({"vector": [9.0], "dim": 1}))
    found, counts = embed.embed(texts_of(spark, "a", "a", "b", "c", "d"), e, str(folder))
    told = cached(found)
    assert told["a"] == (True, (1.0, 0.5)) and not any(told[x][0] for x in "bcd")
    assert tuple(counts.first()) == (2, 3)
    for f in folder.glob("*.json"):
        f.unlink()
    found, counts = embed.embed(texts_of(spark, "a", "b", "e"), e, str(folder))
    assert tuple(counts.first()) == (2, 1) and cached(found)["a"] == (True, (1.0, 0.5))
    plain = cached(embed.embed(texts_of(spark, "b", "e"), e)[0])
    assert {t: v for t, (_, v) in plain.items()} == {t: v for t, (_, v) in cached(found).items() if t != "a"}
    assert embed.embed(texts_of(spark).limit(0), e, str(folder))[0].count() == 0


def test_cache_of_another_layout_is_put_aside(spark, tmp_path, monkeypatch):
    e = PRESETS["stub"]
    embed.embed(texts_of(spark, "a"), e, str(tmp_path))
    monkeypatch.setattr(embed, "LAYOUT", 3)
    _, counts = embed.embed(texts_of(spark, "a"), e, str(tmp_path))
    assert tuple(counts.first()) == (0, 1)
    assert tuple(embed.embed(texts_of(spark, "a"), e, str(tmp_path))[1].first()) == (1, 0)
    assert [p.name[:16] for p in tmp_path.glob("*.bak")] == ["embeddings.v2-" + p.name[14:16] for p in tmp_path.glob("*.bak")] and len(list(tmp_path.glob("*.bak"))) == 1


def test_cache_of_two_writers(spark, tmp_path):
    e, failed = PRESETS["stub"], []

    def write(own):
        try:
            for k in range(2):
                embed.embed(texts_of(spark, f"{own}{k}", f"both{k}"), e, str(tmp_path))[0].collect()
        except Exception as x:  # noqa: BLE001
            failed.append(x)

    threads = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found, counts = embed.embed(texts_of(spark, "a0", "a1", "b0", "b1", "both0", "both1"), e, str(tmp_path))
    assert not failed and tuple(counts.first()) == (6, 0)


def test_cache_of_a_scan_with_a_bad_file(spark, tree):
    c = replace(CONFIG, cache=Cache(path=str(tree / "cache")))
    first = engine.scan(spark, ["src"], c)
    assert first.stats["cache_hits"] == 0 and first.stats["cache_misses"] == first.stats["snippet_count"]
    again = engine.scan(spark, ["src"], c)
    assert again.stats["cache_misses"] == 0 and found(again) == found(first)
    for f in (tree / "cache").rglob("part-*.parquet"):
        f.write_bytes(f.read_bytes()[:40])
    third = engine.scan(spark, ["src"], c)
    assert third.stats["cache_hits"] == 0 and found(third) == found(first)
    assert engine.scan(spark, ["src"], c).stats["cache_misses"] == 0
    assert third.findings.select(F.max("score")).first()[0] <= 1.0
