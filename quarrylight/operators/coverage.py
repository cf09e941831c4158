"""Calls run on a source in a process of its own, with the value, the lines and the branches of each; tests made of them; and the
search for calls that reach more."""

from __future__ import annotations

import ast
import json
import random
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.pycode import compiles
from quarrylight.operators.lineage import checkpointed
from quarrylight.operators.sandbox import ALLOWED_BUILTINS, ALLOWED_IMPORTS, run_job, source_violations

#: A branch (from, to) of lines is one number: from * ARC + to.
ARC = 1 << 20

# The child: limits itself, then runs each statement on a fresh copy of the source and notes what ran and what `result` (or
# `output`) holds. Values that JSON can hold are given in full (a tuple stays one), others up to 2,000 characters.
_CHILD = """
import builtins, contextlib, io, json, random, resource, signal, sys
job = json.load(sys.stdin)
sys.setrecursionlimit(200)
for kind, top in ((resource.RLIMIT_AS, 512 << 20), (resource.RLIMIT_FSIZE, 1 << 20), (resource.RLIMIT_NOFILE, 64)):
    resource.setrlimit(kind, (top, top))
allowed, plain = set(job["imports"]), builtins.__import__
def importer(name, globals=None, locals=None, fromlist=(), level=0):
    if level or name.split(".")[0] not in allowed:
        raise ImportError("import of %r is not allowed" % name)
    return plain(name, globals, locals, fromlist, level)
safe = {k: getattr(builtins, k) for k in job["builtins"]} | {k: v for k, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, BaseException)}
safe["__import__"] = importer
class Late(BaseException):
    pass
def late(*_):
    raise Late()
signal.signal(signal.SIGALRM, late)
def run(call):
    lines, arcs, last = set(), set(), [None]
    def trace(frame, event, arg):
        if frame.f_code.co_filename != "<source>":
            return None
        if event == "line":
            here = frame.f_lineno
            lines.add(here)
            if last[0] is not None:
                arcs.add(last[0] * job["arc"] + here)
            last[0] = here
        return trace
    space = {"__builtins__": safe, "__name__": "subject"}
    ok, error, value = False, "", None
    random.seed(0)
    signal.setitimer(signal.ITIMER_REAL, job["timeout"])
    try:
        exec(compile(job["source"], "<source>", "exec"), space)
        code = compile(call, "<call>", "exec")
        sys.settrace(trace)
        exec(code, space)
        sys.settrace(None)
        found = space.get("result", space.get("output"))
        value = None if found is None else repr(found)
        try:
            json.dumps(found)
        except (TypeError, ValueError, OverflowError):
            value = value[:2000]
        ok = True
    except Late:
        error = "TIMEOUT"
    except BaseException as e:
        error = type(e).__name__ + ": " + str(e)[:200]
    finally:
        sys.settrace(None)
        signal.setitimer(signal.ITIMER_REAL, 0)
    return [ok, error, value, sorted(lines), sorted(arcs)]
with contextlib.redirect_stdout(io.StringIO()):
    out = [run(call) for call in job["calls"]]
sys.__stdout__.write("\\n" + json.dumps(out))
"""

_NAMES = ("ok", "error", "value", "lines", "arcs")
RUN = "struct<call:string,ok:boolean,error:string,value:string,lines:array<int>,arcs:array<long>>"


def run_calls(source: str | None, calls: list[str], timeout: float = 0.5) -> list[dict]:
    """What each statement does on the source, one process for all of them. value is null for None and where it fails."""
    if not calls:
        return []
    fault = (source_violations(source or "") or [""])[0]
    rows: list[list] = []
    if not fault:
        job = {"source": source or "", "calls": calls, "timeout": timeout, "arc": ARC, "imports": ALLOWED_IMPORTS, "builtins": ALLOWED_BUILTINS}
        try:
            rows = json.loads(run_job(_CHILD, job, timeout * len(calls) + 5).rsplit("\n", 1)[-1])
        except subprocess.TimeoutExpired:
            fault = "TIMEOUT"
        except (ValueError, OSError) as e:
            fault = f"WORKER: {type(e).__name__}"
    rows = rows or [[False, fault, None, [], []]] * len(calls)
    return [{"call": c, **dict(zip(_NAMES, r, strict=True))} for c, r in zip(calls, rows, strict=True)]


def runs_column(source: str, calls: str, timeout: float = 0.5) -> Column:
    """array<RUN>: what each of an array of statements does on a source."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, lists in batches:
            yield pd.Series([run_calls(s, [] if c is None else [x for x in c if x is not None], timeout) for s, c in zip(sources, lists, strict=True)])

    return F.pandas_udf(run, f"array<{RUN}>")(source, calls)


def assertion(call: Column, ok: Column, value: Column) -> Column:
    """The test that a call makes: what it returned is expected again. A call that fails or returns None stays as it is."""
    expression = F.trim(F.replace(call, F.lit("result = "), F.lit("")))
    return F.when(ok & value.isNotNull(), F.concat(F.lit("assert "), expression, F.lit(" == "), value)).otherwise(call)


def asserted(calls: DataFrame, ident: str, code: str, nth: str, call: str, timeout: float = 0.5) -> DataFrame:
    """(ident, nth, call, ok, error, test) of calls, one process for the calls of one source."""
    grouped = calls.groupBy(ident, code).agg(F.array_sort(F.collect_list(F.struct(F.col(nth).alias("nth"), F.col(call).alias("call")))).alias("_c"))
    ran = grouped.withColumn("_calls", F.transform("_c", lambda c: c["call"])).select(ident, "_c", runs_column(code, "_calls", timeout).alias("_r"))
    rows = ran.select(ident, F.inline(F.arrays_zip("_c", "_r"))).select(ident, F.col("_c.nth").alias(nth), F.col("_c.call").alias(call), F.col("_r.ok").alias("ok"), F.col("_r.error").alias("error"), F.col("_r.value").alias("_v"))
    return rows.select(ident, nth, call, "ok", "error", assertion(F.col(call), F.col("ok"), F.col("_v")).alias("test"))


# ---- search

# What a string in a call becomes.
STRINGS = ('""', '"a"', '"xyz"', '" "', '"123"', '"!@#"')


def _number(m: re.Match, rng: random.Random) -> str:
    n = int(m[0])
    return str(rng.choice([n + 1, n - 1, 2 * n, 0, 1, -1, n + rng.randint(-10, 10)]))


def _list(m: re.Match, rng: random.Random) -> str:
    inside, extra = m[1].strip(), str(rng.randint(-5, 5))
    return rng.choice(["[]", f"[{inside}, {extra}]" if inside else f"[{extra}]", f"{m[0]} + {m[0]}", m[0]])


def _swapped(m: re.Match, rng: random.Random) -> str:
    items = m[1].split(",")
    if len(items) > 1:
        i, j = rng.sample(range(len(items)), 2)
        items[i], items[j] = items[j], items[i]
    return f"({','.join(items)})"


#: Ways to change a call: a pattern, one match of which is chosen, and what it becomes.
CHANGES = (
    (re.compile(r"(?<![a-zA-Z_])-?\d+"), _number),
    (re.compile(r"\[([^\[\]]*)\]"), _list),
    (re.compile(r'"[^"]*"'), lambda m, rng: rng.choice(STRINGS)),
    (re.compile(r"\bTrue\b|\bFalse\b"), lambda m, rng: "False" if m[0] == "True" else "True"),
    (re.compile(r"\((.+)\)"), _swapped),
)


def varied(call: str, rng: random.Random, changes=CHANGES) -> str:
    """A call with one change of a kind chosen first; the same call where that kind has no place."""
    pattern, make = rng.choice(changes)
    found = list(pattern.finditer(call))
    if not found:
        return call
    m = rng.choice(found)
    return call[: m.start()] + make(m, rng) + call[m.end() :]


_CORPUS = "array<struct<call:string,ok:boolean,value:string>>"


def _accepted(by_output: bool) -> Column:
    """Fold the runs of a round into a function's state, in their order: what reaches a line or branch that nothing before it
    reached is kept, or, by output, what returns a new value."""
    none = lambda t: F.array().cast(f"array<{t}>")  # noqa: E731, F841
    start = F.struct(F.col("corpus").alias("corpus"), F.col("lines").alias("lines"), F.col("arcs").alias("arcs"), F.col("outputs").alias("outputs"))

    def step(s: Column, r: Column) -> Column:
        key = F.coalesce(r["value"], F.lit("None"))
        fresh_ = (r["ok"] & ~F.array_contains(s["outputs"], key)) if by_output else ((F.size(F.array_except(r["lines"], s["lines"])) > 0) | (F.size(F.array_except(r["arcs"], s["arcs"])) > 0))
        kept = F.struct(r["call"].alias("call"), r["ok"].alias("ok"), r["value"].alias("value"))
        return F.struct(
            F.when(fresh_, F.concat(s["corpus"], F.array(kept))).otherwise(s["corpus"]).alias("corpus"), F.array_union(s["lines"], r["lines"]).alias("lines"), F.array_union(s["arcs"], r["arcs"]).alias("arcs"),
            F.when(r["ok"], F.array_union(s["outputs"], F.array(key))).otherwise(s["outputs"]).alias("outputs"),
        )

    return F.aggregate("ran", start, step)


def explore(functions: DataFrame, ident: str, code: str, seeds: str, n: int, steps: int = 50, width: int = 10, by: str = "coverage", seed: int = 42, timeout: float = 0.5) -> DataFrame:
    """(ident, lines, arcs, tests): calls found by growing a corpus, as at most n tests, and all lines and branches reached.

    seeds holds each function's first calls; those that reach something new are its corpus. Then, in rounds of `width` calls
    and `steps` calls in all, calls of the corpus are changed, run and kept on the same condition, until the corpus holds 2n
    calls (n by output). A function whose seeds reach nothing has no corpus and no tests. Rounds end for all functions at
    once; the state of a function is one row, checkpointed each round, and calls are drawn from its ident, the round and the
    seed, so a lost task gives the same calls again.
    """
    by_output = by == "output"
    enough = n if by_output else 2 * n
    changes = CHANGES[:1] if by_output else CHANGES

    def children(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, corpora, rounds in batches:
            out = []
            for name, corpus, nth in zip(names, corpora, rounds, strict=True):
                rng = random.Random(f"{name}:{nth}:{seed}")
                known = [] if corpus is None else list(corpus)
                made = [varied(rng.choice(known), rng, changes) for _ in range(width)] if 0 < len(known) < enough else []
                out.append([c for c in made if compiles(c)])
            yield pd.Series(out)

    grown = F.pandas_udf(children, "array<string>")
    empty = [F.array().cast(t).alias(c) for c, t in (("corpus", _CORPUS), ("lines", "array<int>"), ("arcs", "array<long>"), ("outputs", "array<string>"))]
    state = functions.select(F.col(ident), F.col(code).alias("source"), F.col(seeds).alias("calls"), *empty)
    for nth in range(1 + -(-steps // width)):
        if nth:
            state = state.withColumn("calls", grown(F.col(ident).cast("string"), F.transform("corpus", lambda c: c["call"]), F.lit(nth)))
        ran = state.withColumn("ran", runs_column("source", "calls", timeout)).withColumn("s", _accepted(by_output))
        state = checkpointed(ran.select(ident, "source", "calls", "s.*"))
        if nth and state.filter(F.size("calls") > 0).isEmpty():
            break
    tests = F.transform(F.slice("corpus", 1, n), lambda c: assertion(c["call"], c["ok"], c["value"]))
    return state.select(ident, F.array_sort("lines").alias("lines"), F.array_sort("arcs").alias("arcs"), tests.alias("tests"))


# ---- branches that calls leave out


def possible_branches(source: str | None, entry_point: str | None) -> list[int]:
    """The branches (from * ARC + to) that a function's tests and loops can take from one line to another, sorted.

    A way that leaves the function, and one to another statement of the same line, is no branch, as no line is seen there.
    """
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    function = next((n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == entry_point), None)
    found: set[tuple[int, int | None]] = set()

    def walk(block: list[ast.stmt], after: int | None, loop: tuple[int | None, int | None]) -> None:
        """after: the line that follows the block; loop: the lines that continue and break lead to."""
        for i, s in enumerate(block):
            follows = block[i + 1].lineno if i + 1 < len(block) else after
            if isinstance(s, (ast.If, ast.While, ast.For, ast.AsyncFor)):
                back = s.lineno if not isinstance(s, ast.If) else follows
                inner = (s.lineno, follows) if not isinstance(s, ast.If) else loop
                found.add((s.lineno, s.body[0].lineno))
                found.add((s.lineno, s.orelse[0].lineno if s.orelse else follows))
                walk(s.body, back, inner)
                walk(s.orelse, follows, loop)
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                walk(s.body, follows, loop)
            elif isinstance(s, ast.Try):
                end = s.finalbody[0].lineno if s.finalbody else follows
                walk(s.body, s.orelse[0].lineno if s.orelse else end, loop)
                for part in (s.orelse, *(h.body for h in s.handlers)):
                    walk(part, end, loop)
                walk(s.finalbody, follows, loop)
            elif isinstance(s, ast.Match):
                for case in s.cases:
                    walk(case.body, follows, loop)

    if function:
        walk(function.body, None, (None, None))
    return sorted(a * ARC + b for a, b in found if b is not None and a != b)


def branches_column(source: str, entry_point: str) -> Column:
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, entries in batches:
            yield pd.Series([possible_branches(s, e) for s, e in zip(sources, entries, strict=True)])

    return F.pandas_udf(find, "array<long>")(source, entry_point)


def branch_coverage(functions: DataFrame, ident: str, code: str, entry_point: str, calls: str, timeout: float = 0.5) -> DataFrame:
    """(ident, branches, reached, missing): how many branches a function has, how many its calls take, and those that none takes,
    as (from, to) lines in order. A function without branches misses none."""
    ran = functions.select(ident, branches_column(code, entry_point).alias("_all"), runs_column(code, calls, timeout).alias("_runs"))
    taken = F.array_distinct(F.flatten(F.transform("_runs", lambda r: r["arcs"])))
    pair = lambda a: F.struct(F.floor(a / ARC).cast("int").alias("from"), (a % ARC).cast("int").alias("to"))
    missing = F.array_sort(F.array_except("_all", taken))
    return ran.select(ident, F.size("_all").alias("branches"), (F.size("_all") - F.size(missing)).alias("reached"), F.transform(missing, pair).alias("missing"))
