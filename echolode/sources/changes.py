"""Files that a work tree changed, by git."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence

from ..config import EngineError


class GitError(EngineError, RuntimeError):
    """git failed or isn't there."""


def _names(args: list[str]) -> list[str]:
    try:
        done = subprocess.run(["git", *args], capture_output=True, text=True)
    except OSError as e:
        raise GitError(str(e)) from e
    if done.returncode:
        raise GitError(done.stderr.strip() or "git failed")
    return [x.strip() for x in done.stdout.splitlines() if x.strip()]


def changed_files(base: str = "HEAD", paths: Sequence[str] | None = None) -> list[str]:
    """Tracked files that differ from ``base`` and untracked ones, each once."""
    only = ["--", *paths] if paths else []
    return list(dict.fromkeys(_names(["diff", "--name-only", base, *only]) + _names(["ls-files", "--others", "--exclude-standard", *only])))


def shown(path: str) -> str:
    """A path as reports name it: from the working folder if it lies below, without a leading ./"""
    if os.path.isabs(path) and not os.path.relpath(path).startswith(".."):
        path = os.path.relpath(path)
    return path.removeprefix("./")
