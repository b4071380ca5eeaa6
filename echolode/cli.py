"""Command line: ``python -m echolode.cli scan|diff``."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Config, load
from .plans import engine
from .plans.report import WRITERS

# For kinds of repositories, the globs that are taken and those that are left out.
REPOSITORIES = {
    "cpp": (["**/*.c", "**/*.cc", "**/*.cpp", "**/*.cxx", "**/*.h", "**/*.hh", "**/*.hpp", "**/*.hxx"], ["**/build/**", "**/out/**", "**/bin/**", "**/obj/**", "**/cmake-build-*/**"]),
    "dotnet": (["**/*.cs", "**/*.vb", "**/*.fs"], ["**/bin/**", "**/obj/**", "**/packages/**", "**/.vs/**"]),
    "go": (["**/*.go"], ["**/vendor/**", "**/bin/**", "**/dist/**", "**/.git/**"]),
    "java": (["**/*.java"], ["**/target/**", "**/build/**", "**/.gradle/**", "**/out/**"]),
    "kotlin": (["**/*.kt", "**/*.kts"], ["**/build/**", "**/.gradle/**", "**/out/**"]),
    "node": (["**/*.js", "**/*.mjs", "**/*.cjs", "**/*.ts"], ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/.turbo/**", "**/coverage/**"]),
    "php": (["**/*.php"], ["**/vendor/**", "**/node_modules/**", "**/storage/**", "**/bootstrap/cache/**"]),
    "python": (["**/*.py"], ["**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/site-packages/**"]),
    "react": (["**/*.js", "**/*.jsx", "**/*.ts", "**/*.tsx"], ["**/node_modules/**", "**/.next/**", "**/dist/**", "**/build/**", "**/coverage/**"]),
    "ruby": (["**/*.rb", "**/*.rake"], ["**/vendor/**", "**/tmp/**", "**/log/**", "**/coverage/**"]),
    "rust": (["**/*.rs"], ["**/target/**"]),
    "swift": (["**/*.swift"], ["**/.build/**", "**/DerivedData/**", "**/build/**"]),
}


def preset_globs(kinds: list[str]) -> tuple[list[str], list[str]]:
    """Globs of repository kinds; monorepo is all of them, none is none."""
    kinds = sorted(REPOSITORIES) if "monorepo" in kinds else [k for k in kinds if k != "none"]
    take, leave = (list(dict.fromkeys(g for k in kinds for g in REPOSITORIES[k][side])) for side in (0, 1))
    return take, leave


def merge_globs(include: list[str], exclude: list[str], more: list[str], less: list[str]) -> tuple[list[str], list[str]]:
    """Command-line globs win over the settings'; one in both command-line lists is in neither result."""
    keep = lambda base, own, other: [g for g in dict.fromkeys([*base, *own]) if g not in other]
    return keep(include, more, less), keep(exclude, less, more)


def config_root(paths: list[str]) -> Path:
    """The one folder with a pyproject file that all paths lie in, else what the paths have in common."""
    tops = [p if p.is_dir() else p.parent for p in (Path(x).resolve() for x in paths or ["."])]
    roots = {next((d for d in (t, *t.parents) if (d / "pyproject.toml").is_file()), None) for t in tops}
    return roots.pop() if len(roots) == 1 and None not in roots else Path(os.path.commonpath(tops))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("echolode")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("scan", "diff"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="*", default=["."])
        p.add_argument("--format", choices=sorted(WRITERS), default="json")
        p.add_argument("--out", default="echolode_report.json")
        for x in ("engine", "embedder", "index", "device"):
            p.add_argument(f"--{x}")
        p.add_argument("--state", default="", help="folder that remembers neighbours, so that only what changed is searched for")
        if name == "diff":
            p.add_argument("--base", default="HEAD")
            continue
        for x, kind in (("threshold-func", float), ("threshold-win", float), ("threshold-exp", float), ("min-window-hits", int), ("lexical-min-ratio", float), ("lexical-weight", float), ("window-lines", int), ("stride-lines", int), ("min-nonempty", int), ("cluster-min-size", int), ("expand-depth", int), ("expand-max-chars", int)):
            p.add_argument(f"--{x}", type=kind)
        p.add_argument("--cluster", action="store_true", default=None)
        p.add_argument("--expand-calls", action="store_true", default=None)
        p.add_argument("--cache-path")
        p.add_argument("--repotype", action="append", choices=[*sorted(REPOSITORIES), "monorepo", "none"])
        p.add_argument("--include-glob", action="append", default=[])
        p.add_argument("--exclude-glob", action="append", default=[])
    return top


def overrides(a: argparse.Namespace) -> dict:
    get = lambda name: getattr(a, name, None)
    name = a.embedder or ("stub" if os.environ.get("ECHOLODE_EMBEDDER") == "stub" else None)
    # a depth or a size alone switches expansion on
    any_expansion = get("expand_calls") or get("expand_depth") is not None or get("expand_max_chars") is not None
    said = {
        "engine": a.engine,
        "embedder": {"name": name, "device": a.device},
        "index": {"name": a.index},
        "thresholds": {"func": get("threshold_func"), "win": get("threshold_win"), "exp": get("threshold_exp"), "min_window_hits": get("min_window_hits"), "lexical_min_ratio": get("lexical_min_ratio"), "lexical_weight": get("lexical_weight")},
        "windows": {k: get(k) for k in ("window_lines", "stride_lines", "min_nonempty")},
        "expansion": {"enabled": any_expansion or None, "depth": get("expand_depth"), "max_chars": get("expand_max_chars")},
        "cache": {"path": get("cache_path")},
        "cluster_findings": get("cluster"),
        "cluster_min_size": get("cluster_min_size"),
    }
    clean = {k: {x: y for x, y in v.items() if y is not None} if isinstance(v, dict) else v for k, v in said.items()}
    return {k: v for k, v in clean.items() if v not in (None, {})}


def run(spark: SparkSession, argv: list[str] | None = None) -> engine.ScanResult:
    a = parser().parse_args(argv)
    config: Config = load(config_root(a.paths) if a.command == "scan" else Path.cwd(), overrides(a))
    if a.command == "scan":
        take, leave = preset_globs(a.repotype or ["monorepo"])
        include, exclude = merge_globs(list(dict.fromkeys([*config.include_globs, *take])), list(dict.fromkeys([*config.exclude_globs, *leave])), a.include_glob, a.exclude_glob)
        result = engine.scan(spark, a.paths, replace(config, include_globs=tuple(include), exclude_globs=tuple(exclude)), a.state)
    else:
        result = engine.diff(spark, a.base, a.paths, config, a.state)
    WRITERS[a.format](result, a.out)
    return result


if __name__ == "__main__":
    run(SparkSession.builder.appName("echolode").getOrCreate())
