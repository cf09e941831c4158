"""Findings on functions: contract tests, probes against a reference, static signs, and the lines that a run covers."""

from __future__ import annotations

import ast
import json
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.sandbox import ALLOWED_BUILTINS, ALLOWED_IMPORTS, source_violations

# What a parameter is probed with, by the kind of its hint.
PROBES = {"int": ("0", "1", "-1"), "float": ("0.0", "1.5", "-1.5"), "str": ("''", "'a'", "'A b'"), "bool": ("True", "False"), "list": ("[]", "[0]", "[3, 1, 2]"), "dict": ("{}", "{'a': 1}")}

# The child: runs each test on the source, and each probe on source and reference, and notes the lines that ran.
_CHILD = """
import builtins, json, resource, signal, sys
job = json.load(sys.stdin)
sys.setrecursionlimit(200)
for kind, top in ((resource.RLIMIT_AS, 512 << 20), (resource.RLIMIT_FSIZE, 1 << 20), (resource.RLIMIT_NOFILE, 64)):
    resource.setrlimit(kind, (top, top))
plain = builtins.__import__
def importer(name, globals=None, locals=None, fromlist=(), level=0):
    if level or name.split(".")[0] not in job["imports"]:
        raise ImportError("import of %r is not allowed" % name)
    return plain(name, globals, locals, fromlist, level)
safe = {k: getattr(builtins, k) for k in job["builtins"]} | {k: v for k, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, BaseException)}
safe["__import__"] = importer
def late(*_):
    raise TimeoutError("TIMEOUT")
signal.signal(signal.SIGALRM, late)
ran = set()
def trace(frame, event, arg):
    if frame.f_code.co_filename != "<source>":
        return None
    if event == "line":
        ran.add(frame.f_lineno)
    return trace
def run(code, name, work):
    space = {"__builtins__": safe, "__name__": "subject"}
    signal.setitimer(signal.ITIMER_REAL, job["timeout"])
    try:
        exec(compile(code, name, "exec"), space)
        sys.settrace(trace)
        return ["ok", repr(work(space))[:500]]
    except BaseException as e:
        return ["TIMEOUT" if isinstance(e, TimeoutError) else type(e).__name__, str(e)[:200]]
    finally:
        sys.settrace(None)
        signal.setitimer(signal.ITIMER_REAL, 0)
tests = [run(job["source"], "<source>", lambda s, t=t: exec(compile(t, "<test>", "exec"), s)) for t in job["tests"]]
calls = []
for c in job["calls"]:
    own = run(job["source"], "<source>", lambda s, c=c: eval(compile(c, "<call>", "eval"), s))
    other = run(job["reference"], "<reference>", lambda s, c=c: eval(compile(c, "<call>", "eval"), s)) if job["reference"] else None
    calls.append([own, other])
sys.__stdout__.write("\\n" + json.dumps([tests, calls, sorted(ran)]))
"""


def _function(source: str, entry_point: str) -> ast.FunctionDef | None:
    try:
        return next((n for n in ast.parse(source).body if isinstance(n, ast.FunctionDef) and n.name == entry_point), None)
    except (SyntaxError, ValueError):
        return None


def probes(function: ast.FunctionDef, limit: int) -> list[str]:
    """The first `limit` calls of the product of each parameter's probes, in order."""
    kinds = [PROBES.get((ast.unparse(a.annotation).partition("[")[0].lower() if a.annotation else "int"), PROBES["int"]) for a in function.args.args]
    out = [""]
    for values in kinds:
        out = [f"{x}, {v}" if x else v for x in out for v in values][:limit] if kinds else out
    return [f"{function.name}({x})" for x in out]


def static_signs(function: ast.FunctionDef) -> list[str]:
    """What a reader would point at: defaults that are shared, handlers of everything, comparisons with None by ==."""
    out = []
    if any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in [*function.args.defaults, *(d for d in function.args.kw_defaults if d)]):
        out.append("mutable_default")
    for n in ast.walk(function):
        if isinstance(n, ast.ExceptHandler) and n.type is None:
            out.append("bare_except")
        if isinstance(n, ast.Compare) and any(isinstance(o, (ast.Eq, ast.NotEq)) for o in n.ops) and any(isinstance(c, ast.Constant) and c.value is None for c in n.comparators):
            out.append("none_by_equality")
    return sorted(set(out))


def analyse(source: str | None, entry_point: str | None, tests: list[str], reference: str | None, limit: int = 12, timeout: float = 0.5) -> tuple[list[tuple[str, str, str]], float]:
    """(findings, share of the function's lines that ran); a finding is (status, kind, detail).

    confirmed: a contract test fails, or a probe's outcome differs from the reference's. potential: a probe raises what is no
    rejection of its arguments, without a reference to compare with. observation: a static sign, or a source that can't run.
    """
    function = _function(source or "", entry_point or "")
    if function is None:
        return [("observation", "no_entry_point", "")], 0.0
    found = [("observation", "static", x) for x in static_signs(function)]
    if faults := source_violations(source) + (source_violations(reference) if reference else []):
        return [*found, ("observation", "not_run", faults[0])], 0.0
    calls = probes(function, limit)
    job = json.dumps({"source": source, "reference": reference or "", "tests": tests, "calls": calls, "timeout": timeout, "imports": ALLOWED_IMPORTS, "builtins": ALLOWED_BUILTINS})
    try:
        with tempfile.TemporaryDirectory() as empty:  # of this process alone; nothing of it is read again
            done = subprocess.run([sys.executable, "-I", "-S", "-c", _CHILD], input=job, capture_output=True, text=True, timeout=timeout * (len(tests) + 2 * len(calls)) + 5, check=False, env={"PYTHONHASHSEED": "0"}, cwd=empty)
        ran_tests, ran_calls, lines = json.loads(done.stdout.rsplit("\n", 1)[-1])
    except (subprocess.TimeoutExpired, ValueError, OSError) as e:
        return [*found, ("observation", "not_run", type(e).__name__)], 0.0
    found += [("confirmed", "contract", t) for t, (state, _) in zip(tests, ran_tests, strict=True) if state != "ok"]
    for call, (own, other) in zip(calls, ran_calls, strict=True):
        if other is not None and (own[0] != other[0] or own[0] == "ok" and own[1] != other[1]):
            found.append(("confirmed", "differs", call))
        elif other is None and own[0] not in ("ok", "TypeError", "ValueError"):
            found.append(("potential", own[0], call))
    body = {n.lineno for s in function.body for n in ast.walk(s) if isinstance(n, ast.stmt)}
    return found, len(body & set(lines)) / max(1, len(body))


FINDINGS = "struct<coverage:double,findings:array<struct<status:string,kind:string,detail:string>>>"


def findings(functions: DataFrame, limit: int = 12, timeout: float = 0.5) -> DataFrame:
    """One row for each finding of each function (id, status, kind, detail, coverage); functions: id, code, entry_point,
    test_cases, reference. A function without findings has one row of status clean. Null columns count as empty."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for code, entry, tests, reference in batches:
            rows = [analyse(c, e, [] if t is None else list(t), r, limit, timeout) for c, e, t, r in zip(code, entry, tests, reference, strict=True)]
            yield pd.DataFrame({"coverage": [c for _, c in rows], "findings": [[dict(zip(("status", "kind", "detail"), x, strict=True)) for x in f] for f, _ in rows]})

    found = functions.select("id", F.pandas_udf(run, FINDINGS)("code", "entry_point", "test_cases", "reference").alias("x"))
    return found.select("id", F.round("x.coverage", 6).alias("coverage"), F.explode_outer("x.findings").alias("f")).select("id", F.coalesce("f.status", F.lit("clean")).alias("status"), "f.kind", "f.detail", "coverage")
