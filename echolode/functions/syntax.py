"""Python source: functions of a module, and text without comments and docstrings. Texts: windows of lines, and tokens."""

from __future__ import annotations

import ast
from collections.abc import Iterator


def parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def functions(source: str) -> Iterator[tuple[str, int, int, str]]:
    """Dotted name, first line, last line and code of each function, outer ones first; none if it doesn't parse."""
    tree = parsed(source)
    if tree is None:
        return
    lines = source.splitlines()
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while todo:
        node, names = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            names = (*names, node.name)
            if not isinstance(node, ast.ClassDef):
                last = node.end_lineno or node.lineno
                yield ".".join(names), node.lineno, last, "\n".join(lines[node.lineno - 1 : last])
        todo.extend((child, names) for child in reversed(list(ast.iter_child_nodes(node))))


def normalised(source: str) -> str:
    """Re-printed source with module and function docstrings as ``pass``; what doesn't parse stays as it is."""
    tree = parsed(source)
    if tree is None:
        return source
    for node in ast.walk(tree):
        if isinstance(node, ast.Module | ast.FunctionDef | ast.AsyncFunctionDef) and ast.get_docstring(node, clean=False) is not None:
            node.body[0] = ast.copy_location(ast.Pass(), node.body[0])
    try:
        return ast.unparse(ast.fix_missing_locations(tree))
    except (ValueError, RecursionError):
        return source


def windows(text: str, size: int, stride: int, least: int) -> Iterator[tuple[int, int, str]]:
    """Sliding windows of lines: line before the first, last line, text; those with at least ``least`` lines that aren't blank."""
    lines = text.splitlines()
    inked = [bool(x.strip()) for x in lines]
    for at in range(0, len(lines), stride):
        if sum(inked[at : at + size]) >= least:
            yield at, min(at + size, len(lines)), "\n".join(lines[at : at + size])


#: of each byte that can't be in a token a blank; bytes of other characters than ASCII are none of a token's
APART = bytes(x if chr(x) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for x in range(256))


def tokens(text: str) -> list[bytes]:
    """Distinct lower-case ASCII identifiers and numbers, sorted."""
    return sorted(set(text.lower().encode("utf-8", "replace").translate(APART).split()))
