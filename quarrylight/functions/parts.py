"""A Python source as a table of its parts: imports, definitions, class headers, class attributes. Everything that compares or
selects parts is left to joins; only the parse is done row by row."""

from __future__ import annotations

import ast
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: owner is the nth of the class that a part stands in directly, or -1. A class's text is its header: decorators and the lines
#: before the first of its body. refs are the names that a definition reads from self or cls, bases those that a class derives from.
PARTS = "array<struct<nth:int,kind:string,type:string,name:string,owner:int,top:boolean,text:string,digest:string,refs:array<string>,bases:array<string>,indent:int>>"

_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def digest(node: ast.AST) -> str:
    """Equal for parts that differ in layout, comments or place only."""
    return hashlib.sha256(ast.dump(node, include_attributes=False).encode("utf-8", "surrogatepass")).hexdigest()


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


def _kind(node: ast.AST, parent: ast.AST) -> str | None:
    if isinstance(node, ast.ClassDef):
        return "class"
    if isinstance(node, _DEFINITIONS):
        return "def"
    if isinstance(node, (ast.Import, ast.ImportFrom)) and isinstance(parent, ast.Module):
        return "import"
    return "field" if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(parent, ast.ClassDef) else None


def parts(source: str | None) -> list[dict] | None:
    """The parts of a source in the order of their places; None if it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return None
    lines = list(io.StringIO(source or ""))
    out: list[dict] = []
    waiting: list[tuple[ast.AST, ast.AST, int]] = [(n, tree, -1) for n in reversed(tree.body)]
    while waiting:
        node, parent, owner = waiting.pop()
        kind, nth = _kind(node, parent), len(out)
        if kind:
            last = min(n.lineno for n in node.body) - 1 if kind == "class" else node.end_lineno
            text = "".join(lines[_first_line(node) - 1 : last])
            seen = (n for n in ast.walk(node) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in ("self", "cls"))
            out.append({
                "nth": nth, "kind": kind, "type": type(node).__name__, "name": getattr(node, "name", None), "owner": owner, "top": parent is tree,
                "text": text if kind == "class" else text.rstrip() + "\n", "digest": digest(node), "refs": sorted({n.attr for n in seen}) if kind == "def" else [],
                "bases": [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))] if kind == "class" else [], "indent": node.col_offset,
            })
        waiting += [(c, node, nth if kind == "class" else -1) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def parts_column(source: Column | str) -> Column:
    """The parts of a source; null if it does not parse or is null."""

    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield pd.Series([None if s is None else parts(s) for s in sources])

    return F.pandas_udf(split, PARTS)(source)
