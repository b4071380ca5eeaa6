"""Python source: what functions call, what their variables are bound to, what they return, what modules import."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from pathlib import PurePosixPath

from .syntax import parsed


def in_order(tree: ast.AST) -> Iterator[ast.AST]:
    """All nodes, each before its children, children in the order of the source."""
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(list(ast.iter_child_nodes(node))))


def callee(node: ast.AST) -> tuple[str, str | None, str] | None:
    """Form, base and name of what is called: ``f()``, ``x.f()`` or ``C().f()``; None for anything else."""
    match node:
        case ast.Name(id=name):
            return "name", None, name
        case ast.Attribute(value=ast.Name(id=base), attr=name):
            return "attr", base, name
        case ast.Attribute(value=ast.Call(func=ast.Name(id=base)), attr=name):
            return "ctor", base, name
    return None


def bound(node: ast.AST) -> Iterator[tuple[str, str, str | None, str]]:
    """Variable, form, base and name for each variable that a statement may bind to an instance."""
    match node:
        case ast.Assign(targets=targets, value=ast.Call(func=func)) if (told := callee(func)) and told[0] != "ctor":
            form = {"name": "made", "attr": "made_by"}[told[0]]
            yield from ((t.id, form, *told[1:]) for t in targets if isinstance(t, ast.Name))
        case ast.Assign(targets=targets, value=ast.Name(id=other)):
            yield from ((t.id, "same", None, other) for t in targets if isinstance(t, ast.Name))
        case ast.AnnAssign(target=ast.Name(id=var), annotation=ast.Name(id=name)):
            yield var, "told", None, name
        case ast.AnnAssign(target=ast.Name(id=var), annotation=ast.Attribute(value=ast.Name(id=base), attr=name)):
            yield var, "told_of", base, name


def facts(code: str) -> tuple[list, list, str | None]:
    """Distinct calls and all bindings of a function in order, and the class that its last ``return C()`` names. Code that
    doesn't parse by itself, as that of indented methods, has none."""
    tree, calls, binds, made = parsed(code), {}, [], None
    for node in in_order(tree) if tree else ():
        if isinstance(node, ast.Call) and (told := callee(node.func)):
            calls.setdefault(told)
        binds.extend(bound(node))
        if isinstance(node, ast.Return) and isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
            made = node.value.func.id
    return list(calls), binds, made


def imports(path: str, source: str) -> Iterator[tuple[str, str | None, str, str, str]]:
    """Alias, name (None: the module itself), module as a path, and the two files that the module would be beside this one;
    only imports at the top level that name a module."""
    tree = parsed(source)
    for node in tree.body if tree else ():
        if isinstance(node, ast.Import):
            told = [(a.asname or a.name.rpartition(".")[2], None, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            told = [(a.asname or a.name, a.name, node.module) for a in node.names if a.name != "*"]
        else:
            continue
        folder = PurePosixPath(path).parent
        for _ in range(getattr(node, "level", 0) or 0):
            folder = folder.parent
        for alias, name, module in told:
            at = folder.joinpath(*module.split("."))
            yield alias, name, module.replace(".", "/"), f"{at}.py", f"{at}/__init__.py"
