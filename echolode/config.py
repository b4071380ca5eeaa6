"""Settings of a scan: defaults, the [tool.echolode] table of a pyproject file, overrides; coercion and ranges."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


class EngineError(Exception):
    """Any failure that a user can mend."""


class ConfigError(EngineError):
    """A setting of the wrong kind or out of range."""


@dataclass(frozen=True)
class Windows:
    window_lines: int = 40
    stride_lines: int = 6
    min_nonempty: int = 4


@dataclass(frozen=True)
class Expansion:
    enabled: bool = False
    depth: int = 1
    max_chars: int = 4000


@dataclass(frozen=True)
class Thresholds:
    func: float = 0.92
    win: float = 0.90
    exp: float = 0.90
    min_window_hits: int = 1
    lexical_min_ratio: float = 0.5
    lexical_weight: float = 0.3


@dataclass(frozen=True)
class Index:
    name: str = "brute"
    top_k: int = 25
    faiss_nlist: int = 128
    faiss_nprobe: int = 8


@dataclass(frozen=True)
class Cache:
    path: str = ""


@dataclass(frozen=True)
class Embedder:
    name: str = "codebert"
    model_name: str = "microsoft/codebert-base"
    revision: str = "main"
    max_length: int = 256
    batch_size: int = 16
    device: str = "auto"
    trust_remote_code: bool = False


# Embedder presets by name.
PRESETS = {"codebert": Embedder(), "faster": Embedder("faster", "isuruwijesiri/all-MiniLM-L6-v2-code-search-512", "main", 512, 32), "stub": Embedder("stub", "stub", "main", 256, 16)}


@dataclass(frozen=True)
class Config:
    engine: str = "semantic"
    include_globs: tuple[str, ...] = ("**/*.py",)
    exclude_globs: tuple[str, ...] = ("**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/site-packages/**")
    windows: Windows = field(default_factory=Windows)
    expansion: Expansion = field(default_factory=Expansion)
    thresholds: Thresholds = field(default_factory=Thresholds)
    index: Index = field(default_factory=Index)
    cache: Cache = field(default_factory=Cache)
    embedder: Embedder = field(default_factory=Embedder)
    cluster_findings: bool = False
    cluster_min_size: int = 2


CHOICES = {"engine": ("semantic", "sonarqube"), "index.name": ("brute", "faiss"), "embedder.name": ("codebert", "faster", "stub")}
POSITIVE = "windows.window_lines windows.stride_lines expansion.max_chars index.top_k index.faiss_nlist index.faiss_nprobe embedder.max_length embedder.batch_size thresholds.min_window_hits cluster_min_size".split()
NOT_NEGATIVE = ("windows.min_nonempty", "expansion.depth")
UNIT = ("thresholds.func", "thresholds.win", "thresholds.exp", "thresholds.lexical_min_ratio", "thresholds.lexical_weight")
WORDS = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


def _coerced(name: str, value: Any, like: Any) -> Any:
    wrong = ConfigError(f"{name}: {value!r} is not {'a list of globs' if isinstance(like, tuple) else type(like).__name__}")
    if isinstance(like, tuple):
        if isinstance(value, str):
            return (value,)
        if isinstance(value, list | tuple) and all(isinstance(x, str) for x in value):
            return tuple(value)
        raise wrong
    if isinstance(like, bool):
        if isinstance(value, bool):
            return value
        if isinstance(value, str) and value.strip().lower() in WORDS:
            return WORDS[value.strip().lower()]
        raise wrong
    if isinstance(like, str):
        if isinstance(value, str):
            return value
        raise wrong
    if isinstance(value, bool):
        raise wrong
    try:
        number = float(value) if isinstance(like, float) else int(value)
    except (TypeError, ValueError):
        raise wrong from None
    if isinstance(like, int) and not isinstance(value, str) and number != value:
        raise wrong
    return number


def merged(base: Any, given: Any, at: str = "") -> Any:
    """``base`` with the settings of a (nested) mapping put in. A given embedder starts from the preset of its name."""
    if not hasattr(given, "items"):
        raise ConfigError(f"{at or 'the settings'}: a table is needed")
    if isinstance(base, Embedder):
        name = given.get("name", base.name)
        base = PRESETS.get(name, replace(base, name=name)) if isinstance(name, str) else base
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    out = {}
    for key, value in given.items():
        key = {"model": "model_name", "nlist": "faiss_nlist", "nprobe": "faiss_nprobe"}.get(key, key)
        if key in known and value is not None:
            name = f"{at}.{key}" if at else key
            out[key] = merged(known[key], value, name) if is_dataclass(known[key]) else _coerced(name, value, known[key])
    return replace(base, **out)


def validate(config: Config) -> Config:
    def value(name: str) -> Any:
        found: Any = config
        for part in name.split("."):
            found = getattr(found, part)
        return found

    for name, allowed in CHOICES.items():
        if value(name) not in allowed:
            raise ConfigError(f"{name}: {value(name)!r} is not one of {', '.join(allowed)}")
    for names, low, high in ((POSITIVE, 1, None), (NOT_NEGATIVE, 0, None), (UNIT, 0, 1)):
        for name in names:
            if value(name) < low or high is not None and value(name) > high:
                raise ConfigError(f"{name}: {value(name)!r} is out of range")
    return config


def load(root: str | Path, overrides: dict | None = None) -> Config:
    """Defaults, then the pyproject file under ``root``, then overrides."""
    config, path = Config(), Path(root) / "pyproject.toml"
    if path.is_file():
        tool = tomllib.loads(path.read_text("utf-8")).get("tool", {})
        if not isinstance(tool, dict):
            raise ConfigError("tool: a table is needed")
        config = merged(config, tool.get("echolode", {}))
    return validate(merged(config, overrides or {}))
