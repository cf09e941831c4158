"""Running candidate tests against a reference and a mutant, in a restricted process of its own."""

from __future__ import annotations

import ast
import json
import os
import subprocess
import sys
import tempfile
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.pycode import candidate_reason

# Modules that code under test may import.
ALLOWED_IMPORTS = (
    "__future__ base64 bisect calendar collections copy dataclasses datetime decimal enum fractions functools hashlib "
    "heapq itertools json math operator random re statistics string typing"
).split()

# Names that code under test may not use.
DENIED_SOURCE_NAMES = frozenset(
    "__import__ breakpoint compile ctypes delattr eval exec getattr globals input locals multiprocessing open os "
    "pathlib pickle requests resource setattr shutil signal socket subprocess sys tempfile threading vars".split()
)

# Builtins that code under test may use, beside the exceptions.
ALLOWED_BUILTINS = (
    "__build_class__ abs all any ascii bin bool bytearray bytes callable chr classmethod complex dict divmod enumerate filter float "
    "format frozenset hash hex int isinstance issubclass iter len list map max min next object oct ord pow print property range repr "
    "reversed round set slice sorted staticmethod str sum super tuple type zip"
).split()


def source_violations(source: str) -> list[str]:
    """Why a source may not run: imports, names, attributes and calls, sorted and each once; empty if it may."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError) as e:
        return [f"source_syntax_error:{getattr(e, 'msg', e)}"]
    found = set()
    for n in nodes:
        roots = [a.name.partition(".")[0] for a in n.names] if isinstance(n, ast.Import) else [(n.module or "").partition(".")[0]] if isinstance(n, ast.ImportFrom) else []
        found |= {f"source_import_not_allowed:{r}" for r in roots if r and r not in ALLOWED_IMPORTS}
        if isinstance(n, ast.Name) and n.id in DENIED_SOURCE_NAMES:
            found.add(f"source_name_not_allowed:{n.id}")
        if isinstance(n, ast.Attribute) and (n.attr.startswith("_") or n.attr in DENIED_SOURCE_NAMES):
            found.add(f"source_attribute_not_allowed:{n.attr}")
    return sorted(found)


# Stands before a child's code. It loads the modules once, and then forks a process for each job, which goes on to that code with
# the job as its input and an empty folder of its own; output beyond the time is not waited for.
_NURSERY = """
import contextlib, gc, io, json, os, random, resource, select, signal, sys, time
for name in @modules@:
    try:
        __import__(name)
    except ImportError:
        pass
gc.freeze()
def take(n):
    data = b""
    while len(data) < n:
        part = os.read(0, n - len(data))
        if not part:
            os._exit(0)
        data += part
    return data
def put(data):
    while data:
        data = data[os.write(1, data):]
while True:
    head = json.loads(take(int(take(8))))
    body = take(head["size"])
    end = time.monotonic() + head["seconds"]
    r, w = os.pipe()
    pid = os.fork()
    if not pid:
        break
    os.close(w)
    found, late = [], False
    while True:
        left = end - time.monotonic()
        if left <= 0 or not select.select([r], [], [], left)[0]:
            late = True
            break
        part = os.read(r, 65536)
        if not part:
            break
        found.append(part)
    os.kill(pid, signal.SIGKILL)
    os.close(r)
    os.waitpid(pid, 0)
    answer = b"" if late else b"".join(found)
    put(b"%d %15d" % (late, len(answer)) + answer)
nothing = os.open("/dev/null", os.O_RDWR)
os.dup2(nothing, 0), os.dup2(w, 1), os.dup2(nothing, 2)
os.close(nothing), os.close(w), os.close(r)
os.chdir(head["folder"])
sys.stdin = io.StringIO(body.decode())
del take, put, head, body, end, r, w, pid, nothing
"""

_RUNNING: dict[tuple[int, str], subprocess.Popen] = {}
_ONE_AT_A_TIME = threading.Lock()


def run_job(child: str, job: dict, seconds: float) -> str:
    """What a child's code prints for a job, in a process of its own; raises TimeoutExpired or OSError. The process that the
    children are forked from stays for the next job and ends with this one."""
    body = json.dumps(job).encode()
    key = (os.getpid(), child)
    with _ONE_AT_A_TIME, tempfile.TemporaryDirectory() as empty:  # of this process alone; nothing of it is read again
        if key not in _RUNNING or _RUNNING[key].poll() is not None:
            code = _NURSERY.replace("@modules@", repr(ALLOWED_IMPORTS)) + child + "\nsys.__stdout__.flush()\nos._exit(0)\n"
            _RUNNING[key] = subprocess.Popen([sys.executable, "-I", "-S", "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0, env={"PYTHONHASHSEED": "0"}, cwd="/")
        nursery = _RUNNING[key]
        head = json.dumps({"size": len(body), "seconds": seconds, "folder": empty}).encode()
        try:
            message = memoryview(b"%8d" % len(head) + head + body)
            while message:
                message = message[nursery.stdin.write(message) :]
            late, size = _taken(nursery, 17).split()
            answer = _taken(nursery, int(size))
        except (OSError, ValueError) as e:
            _RUNNING.pop(key).kill()
            nursery.wait()
            raise OSError(f"no answer: {e}") from e
    if int(late):
        raise subprocess.TimeoutExpired("job", seconds)
    return answer.decode()


def _taken(nursery: subprocess.Popen, n: int) -> bytes:
    data = b""
    while len(data) < n:
        part = nursery.stdout.read(n - len(data))
        if not part:
            raise OSError("the process ended")
        data += part
    return data


# The child: limits itself, then runs each test on the reference and, where that passes, on the mutant.
_CHILD = """
import builtins, json, random, resource, signal, sys
job = json.load(sys.stdin)
sys.setrecursionlimit(200)
seconds = max(1, int(job["timeout"] * len(job["tests"]) * 2 + 1))
for kind, top in ((resource.RLIMIT_AS, 512 << 20), (resource.RLIMIT_FSIZE, 1 << 20), (resource.RLIMIT_NOFILE, 64), (resource.RLIMIT_CPU, seconds)):
    resource.setrlimit(kind, (top, top))
allowed, plain = set(job["imports"]), builtins.__import__
def importer(name, globals=None, locals=None, fromlist=(), level=0):
    if level or name.split(".")[0] not in allowed:
        raise ImportError("import of %r is not allowed" % name)
    return plain(name, globals, locals, fromlist, level)
for name in allowed:
    try:
        plain(name)
    except ImportError:
        pass
safe = {k: getattr(builtins, k) for k in job["builtins"]} | {k: v for k, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, BaseException)}
safe |= {"__import__": importer, "__name__": "builtins", "True": True, "False": False, "None": None}
def late(*_):
    raise TimeoutError("TIMEOUT")
signal.signal(signal.SIGALRM, late)
def run(code, test):
    random.seed(0)
    space = {"__builtins__": safe, "__name__": "candidate"}
    signal.setitimer(signal.ITIMER_REAL, job["timeout"])
    try:
        exec(compile(code, "<code>", "exec"), space)
        exec(compile(test, "<test>", "exec"), space)
        return ""
    except BaseException as e:
        return "TIMEOUT" if isinstance(e, TimeoutError) else type(e).__name__ + ": " + str(e)[:200]
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
out = []
for test in job["tests"]:
    first = run(job["golden"], test)
    second = run(job["mutant"], test) if not first else ""
    out.append([first, second])
sys.__stdout__.write("\\n" + json.dumps(out))
"""


def classify(tests: list[str], golden: str, mutant: str, timeout: float = 1.0) -> list[tuple[str, bool, bool, str]]:
    """(test, valid, killed, error): valid if the reference passes, killed if then the mutant fails in any way."""
    if not tests:
        return []
    if faults := source_violations(golden) + source_violations(mutant):
        return [(t, False, False, faults[0]) for t in tests]
    job = {"tests": tests, "golden": golden, "mutant": mutant, "timeout": timeout, "imports": ALLOWED_IMPORTS, "builtins": ALLOWED_BUILTINS}
    try:
        rows = json.loads(run_job(_CHILD, job, max(1, timeout * len(tests) * 2) + 5).rsplit("\n", 1)[-1])
    except subprocess.TimeoutExpired:
        rows = [["TIMEOUT", ""]] * len(tests)
    except (ValueError, OSError) as e:
        rows = [[f"WORKER: {e}", ""]] * len(tests)
    return [(t, not a, not a and bool(b), a or b) for t, (a, b) in zip(tests, rows, strict=True)]


OUTCOMES = "array<struct<test:string,valid:boolean,killed:boolean,reason:string>>"


def evaluate_pairs(pairs: DataFrame, timeout: float = 1.0) -> DataFrame:
    """One row for each (pair, test): policy first, then the sandbox. pairs: id, golden_code, mutant_code, entry_point, test_cases."""

    @F.pandas_udf(OUTCOMES)
    def outcomes(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for golden, mutant, entry, tests in batches:
            rows = []
            for g, m, e, t in zip(golden, mutant, entry, tests, strict=True):
                t = [] if t is None else list(t)
                reasons = [candidate_reason(x, e) for x in t]
                ran = iter(classify([x for x, r in zip(t, reasons, strict=True) if not r], g, m, timeout))
                rows.append([{"test": x, "valid": False, "killed": False, "reason": r} if r else dict(zip(("test", "valid", "killed", "reason"), next(ran), strict=True)) for x, r in zip(t, reasons, strict=True)])
            yield pd.Series(rows)

    return pairs.select("id", F.inline(outcomes("golden_code", "mutant_code", "entry_point", "test_cases")))
