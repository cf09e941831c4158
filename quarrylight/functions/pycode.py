"""Python source as data: identities, policies and mutants. The functions here are plain; the UDFs take whole Arrow batches."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import warnings
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Limits of a candidate.
MAX_BYTES, MAX_NODES, MAX_DEPTH, MAX_ITEMS, MAX_STRING, MAX_INTEGER = 4096, 160, 24, 128, 2048, 10**12

# Names that a candidate may not use.
DENIED_NAMES = frozenset(
    "__import__ breakpoint compile delattr dir eval exec exit getattr globals help input locals memoryview open quit setattr vars "
    "builtins ctypes importlib multiprocessing os pathlib resource shutil signal socket subprocess sys tempfile".split()
)

# Syntax that a candidate may not use.
DENIED_SYNTAX = (ast.Await, ast.Delete, ast.DictComp, ast.FormattedValue, ast.GeneratorExp, ast.Lambda, ast.ListComp, ast.NamedExpr, ast.SetComp, ast.Starred, ast.Yield, ast.YieldFrom)


# How many sources a process remembers what they come to, and the length of the longest of them.
REMEMBERED, SHORT = 4096, 1000


def remembered(f: Callable) -> Callable:
    """f, a function of a source, with its results for short sources kept: tests and references come again in many records."""
    kept = lru_cache(REMEMBERED)(f)
    return wraps(f)(lambda source: kept(source) if isinstance(source, str) and len(source) <= SHORT else f(source))


def _shape(cls: type) -> tuple[str, tuple[tuple[str, str, bool], ...]]:
    """(name, fields) of a class of nodes; a field is (field, label, whether None is written)."""
    valued = issubclass(cls, (ast.Constant, ast.MatchSingleton))
    return cls.__name__, tuple((f, f"{f}=", valued and f == "value") for f in cls._fields)


#: By class of nodes: its shape, or, if it has no fields, its text.
_SHAPES: dict[type, tuple | str] = {}


def dumped(node: object) -> str:
    """ast.dump of a parsed tree without positions, in a fraction of its time; a part that is no node gives its repr."""
    cls = node.__class__
    shape = _SHAPES.get(cls)
    if shape is None:
        if isinstance(node, list):
            return f"[{', '.join([dumped(x) for x in node])}]"
        if not isinstance(node, ast.AST):
            return repr(node)
        shape = _SHAPES[cls] = _shape(cls) if cls._fields else f"{cls.__name__}()"
    if shape.__class__ is str:
        return shape
    parts, held = [], node.__dict__
    for field, label, null in shape[1]:
        value = held[field] if field in held else getattr(node, field)
        if value.__class__ is str:
            parts.append(label + repr(value))
        elif value.__class__ is list:
            if len(value) == 1:
                parts.append(f"{label}[{dumped(value[0])}]")
            elif value:
                parts.append(f"{label}[{', '.join([dumped(x) for x in value])}]")
        elif null or value is not None:
            parts.append(label + dumped(value))
    return f"{shape[0]}({', '.join(parts)})"


@remembered
def semantic(source: str | None) -> str | None:
    """The syntax tree as text, without positions: equal for sources that differ in layout or comments; None if it does not parse."""
    try:
        return dumped(ast.parse(source)) if source is not None else None
    except (SyntaxError, ValueError):
        return None


def parses(source: str) -> bool:
    """Whether a source has a syntax tree."""
    try:
        ast.parse(source)
    except (SyntaxError, ValueError):
        return False
    return True


_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(value: object) -> str:
    return _CANONICAL.encode(value)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def group_identity(code: str, entry_point: str) -> str | None:
    return tree_identity(semantic(code), entry_point)


def tree_identity(tree: str | None, entry_point: str) -> str | None:
    return None if tree is None else "function:semantic:" + sha256(canonical_json({"entry_point": entry_point, "reference_ast": tree}))


def _depth(tree: ast.AST) -> int:
    deepest, level = 0, [tree]
    while level:
        deepest += 1
        level = [c for n in level for c in ast.iter_child_nodes(n)]
    return deepest


def _node_fault(node: ast.AST) -> str:
    if isinstance(node, DENIED_SYNTAX):
        return f"disallowed_syntax:{type(node).__name__}"
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        return "imports_not_allowed"
    if isinstance(node, ast.Name) and (node.id in DENIED_NAMES or node.id.startswith("__")):
        return f"disallowed_name:{node.id}"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in DENIED_NAMES:
        return f"disallowed_call:{node.func.attr}"
    if isinstance(node, ast.Attribute) and (node.attr in DENIED_NAMES or node.attr.startswith("__")):
        return f"disallowed_attribute:{node.attr}"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in DENIED_NAMES:
        return f"disallowed_call:{node.func.id}"
    if isinstance(node, ast.Constant):
        if isinstance(node.value, str) and len(node.value.encode("utf-8", "surrogatepass")) > MAX_STRING:
            return "string_literal_too_large"
        if isinstance(node.value, int) and not isinstance(node.value, bool) and abs(node.value) > MAX_INTEGER:
            return "integer_literal_too_large"
    items = node.elts if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else node.keys if isinstance(node, ast.Dict) else ()
    return "container_literal_too_large" if len(items) > MAX_ITEMS else ""


def candidate_reason(code: str | None, entry_point: str | None) -> str:
    """Why a candidate assertion is not allowed; '' if it is. The first rule that fails is the reason."""
    if not isinstance(code, str) or not code.strip():
        return "empty_candidate"
    if len(code.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return "candidate_too_large"
    if not (entry_point or "").isidentifier():
        return "invalid_entry_point"
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return f"syntax_error:{getattr(e, 'msg', e)}"
    if len(tree.body) != 1 or not isinstance(tree.body[0], ast.Assert):
        return "candidate_must_be_one_assert"
    nodes = list(ast.walk(tree))
    if len(nodes) > MAX_NODES:
        return "candidate_ast_too_large"
    if _depth(tree) > MAX_DEPTH:
        return "candidate_ast_too_deep"
    fault = next((f for f in map(_node_fault, nodes) if f), "")
    if fault:
        return fault
    called = any(isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == entry_point for n in nodes)
    return "" if called else "target_entry_point_not_called"


def defines(code: str | None, name: str | None) -> bool:
    try:
        return any(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.name == name for n in ast.parse(code or "").body)
    except (SyntaxError, ValueError):
        return False


def assertions(source: str | None, entry_point: str) -> list[str]:
    """The assert statements of a test source in order, `candidate` read as the entry point, each once."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    found = sorted((n for n in ast.walk(tree) if isinstance(n, ast.Assert)), key=lambda n: (n.lineno, n.col_offset))
    for n in found:
        for x in ast.walk(n):
            if isinstance(x, ast.Name) and x.id == "candidate":
                x.id = entry_point
    return list(dict.fromkeys(ast.unparse(n) for n in found))


# Line rewrites as (pattern, replacement, type, description).
REWRITES = (
    (r"(?<![->])\+(?!=)", "-", "arithmetic", "+ -> -"),
    (r"(?<![<>!=])-(?![>])", "+", "arithmetic", "- -> +"),
    (r"\*(?!\*)", "/", "arithmetic", "* -> /"),
    (r"(?<!\*)\/(?!\/)", "*", "arithmetic", "/ -> *"),
    (r"\/\/", "%", "arithmetic", "// -> %"),
    (r"(?<!\/)%", "//", "arithmetic", "% -> //"),
    (r"\*\*", "*", "arithmetic", "** -> *"),
    (r"<=", ">=", "comparison", "<= -> >="),
    (r"(?<!=)<(?!=)", ">", "comparison", "< -> >"),
    (r">=", "<=", "comparison", ">= -> <="),
    (r"(?<!=)>(?!=)", "<", "comparison", "> -> <"),
    (r"==", "!=", "comparison", "== -> !="),
    (r"!=", "==", "comparison", "!= -> =="),
    (r"\band\b", "or", "logical", "and -> or"),
    (r"\bor\b", "and", "logical", "or -> and"),
    (r"\bnot ", "", "negate_removal", "remove not"),
    (r"\bTrue\b", "False", "boolean", "True -> False"),
    (r"\bFalse\b", "True", "boolean", "False -> True"),
    (r"(?<!\d\.)(?<!\d)\b0\b(?!\.)", "1", "boundary", "0 -> 1"),
    (r"(?<!\d\.)(?<!\d)\b1\b(?!\.\d)", "0", "boundary", "1 -> 0"),
    (r"(?<!\d\.)(?<!\d)\b1\b(?!\.\d)", "2", "boundary", "1 -> 2"),
    (r"\[0\]", "[1]", "index", "[0] -> [1]"),
    (r"\[-1\]", "[-2]", "index", "[-1] -> [-2]"),
    (r"\[-1\]", "[0]", "index", "[-1] -> [0]"),
    (r" in ", " not in ", "membership", "in -> not in"),
    (r" not in ", " in ", "membership", "not in -> in"),
    (r" is not ", " is ", "identity", "is not -> is"),
    (r" is ", " is not ", "identity", "is -> is not"),
    (r"\.strip\(\)", "", "string", "remove .strip()"),
    (r"\.lower\(\)", ".upper()", "string", ".lower -> .upper"),
    (r"\.upper\(\)", ".lower()", "string", ".upper -> .lower"),
    (r"\.append\(", ".extend([", "collection", ".append -> .extend"),
)
# Off-by-one rewrites of a line's first match, as (pattern, replacement, description).
OFF_BY_ONE = (
    (r"range\(len\((\w+)\)\)", r"range(len(\1) - 1)", r"range(len(\1)) -> range(len(\1)-1)"),
    (r"range\((?!len\))([a-zA-Z_]\w*)\)", r"range(\1 - 1)", r"range(\1) -> range(\1-1)"),
    (r"range\((\w+),\s*(\w+)\)", r"range(\1, \2 - 1)", r"range(\1,\2) -> range(\1,\2-1)"),
    (r"(\w+)\s*\+\s*1\b", r"\1", r"\1+1 -> \1"),
    (r"(\w+)\s*-\s*1\b", r"\1", r"\1-1 -> \1"),
)
# What a returned value becomes.
RETURNS = (("True", "False"), ("False", "True"), ("0", "1"), ("1", "0"), ("[]", "None"), ("None", "0"), ('""', "None"))

# What a template leaves behind when it isn't filled in.
ARTEFACTS = ("\\1", "\\2", "\\3")

_REWRITES = tuple((re.compile(p), r, t, d) for p, r, t, d in REWRITES)
_OFF_BY_ONE = tuple((re.compile(p), r, d) for p, r, d in OFF_BY_ONE)


def logic_lines(code: str) -> set[int]:
    """Numbers (from 0) of the lines of statements in functions, without signatures, docstrings, imports and decorators.

    A choice: lines come from the syntax tree, so that a docstring or a string of several lines is never taken for code.
    """
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return set()
    out: set[int] = set()
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        for i, s in enumerate(f.body):
            text = i == 0 and isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str)
            if not text and not isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)):
                out |= set(range(s.lineno - 1, s.end_lineno))
    lines = code.split("\n")
    return {i for i in out if (x := lines[i].strip()) and not x.startswith(("#", "def ", "async def ", "@", "import ", "from "))}


def is_clean(code: str, mutant: str) -> bool:
    """Whether a mutant differs, parses, and holds no artefact of a template that the source hasn't."""
    return mutant != code and not any(a in mutant and a not in code for a in ARTEFACTS) and semantic(mutant) is not None


def described_mutants(code: str | None) -> list[tuple[int, str, str, str]]:
    """(line, type, description, mutated code) of every clean first-order mutant, line by line and rule by rule.

    Two rules that come to the same code both count. A source of fewer than 30 characters has none.
    """
    if not code or len(code.strip()) < 30:
        return []
    lines, out = code.split("\n"), []
    for i in sorted(logic_lines(code)):
        line = lines[i]
        made = [(t, d, line[: m.start()] + r + line[m.end() :]) for p, r, t, d in _REWRITES for m in p.finditer(line)]
        made += [("off_by_one", m.expand(d), line[: m.start()] + m.expand(r) + line[m.end() :]) for p, r, d in _OFF_BY_ONE if (m := p.search(line))]
        value = re.match(r"\s*return ", line)
        made += [("return", f"return {a} -> {b}", value[0] + b + line[value.end() + len(a) :]) for a, b in RETURNS if value and line.startswith(a, value.end())]
        for kind, description, new in made:
            mutant = "\n".join([*lines[:i], new, *lines[i + 1 :]])
            if is_clean(code, mutant):
                out.append((i + 1, kind, f"{description} (line {i + 1})", mutant))
    return out


def mutants(code: str | None) -> list[tuple[int, str, str]]:
    """(line, type, mutated code) of the first-order mutants, each code once."""
    firsts: dict[str, tuple[int, str, str]] = {}
    for line, kind, _, mutant in described_mutants(code):
        firsts.setdefault(mutant, (line, kind, mutant))
    return list(firsts.values())


def _per_row(f: Callable, schema) -> Callable:
    """A pandas UDF over an iterator of batches that applies f to each row."""

    def batches(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in it:
            yield pd.Series([f(*row) for row in zip(*cols, strict=True)])

    def one(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for col in it:
            yield pd.Series([f(x) for x in col])

    n = f.__code__.co_argcount
    return F.pandas_udf(one if n == 1 else batches, schema)


def identity_column(code, entry_point):
    return _per_row(lambda c, e: group_identity(c, e), StringType())(code, entry_point)


def semantic_hash(code):
    return _per_row(lambda c: None if (t := semantic(c)) is None else sha256(t), StringType())(code)


@remembered
def compiles(code: str | None) -> bool:
    """Whether a source compiles as a module."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            compile(code or "", "<fragment>", "exec")
    except (SyntaxError, ValueError):
        return False
    return code is not None


def compiles_column(code):
    return _per_row(lambda c: compiles(c), BooleanType())(code)


def policy_column(code, entry_point):
    return _per_row(lambda c, e: candidate_reason(c, e), StringType())(code, entry_point)


def assertions_column(source, entry_point):
    return _per_row(lambda s, e: assertions(s, e), ArrayType(StringType()))(source, entry_point)


MUTANTS = "array<struct<line:int,mutation_type:string,description:string,mutant_code:string>>"


def mutants_column(code):
    """Every first-order mutant of a source, in order; equal codes stay."""
    names = ("line", "mutation_type", "description", "mutant_code")
    return _per_row(lambda c: [dict(zip(names, m, strict=True)) for m in described_mutants(c)], MUTANTS)(code)


def with_mutants(functions, code: str = "code"):
    """functions with one row for each distinct mutant (line, mutation_type, mutant_code)."""
    rows = functions.select("*", F.posexplode(mutants_column(code)).alias("_nth", "_m"))
    keys = [F.col(c) for c in functions.columns]
    first = rows.groupBy(*keys, F.col("_m.mutant_code").alias("mutant_code")).agg(F.min_by("_m", "_nth").alias("_m"))
    return first.select(*keys, "_m.line", "_m.mutation_type", "mutant_code")
