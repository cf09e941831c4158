import ast
import time

import pytest

from quarrylight.functions import pycode
from quarrylight.operators import sandbox

GOLD = "def add(a, b):\n    return a + b\n"


@pytest.mark.parametrize(
    ("code", "reason"),
    [
        ("assert add(1, 2) == 3", ""),
        ("", "empty_candidate"),
        ("x" * 5000, "candidate_too_large"),
        ("assert add(1", "syntax_error"),
        ("assert add(1, 2) == 3\nassert True", "candidate_must_be_one_assert"),
        ("import os", "candidate_must_be_one_assert"),
        ("assert open('x')", "disallowed_call:open"),
        ("assert add.__class__", "disallowed_attribute:__class__"),
        ("assert add(*[1, 2]) == 3", "disallowed_syntax:Starred"),
        ("assert [x for x in (1, 2)]", "disallowed_syntax:ListComp"),
        (f"assert add(1, '{'x' * 3000}')", "string_literal_too_large"),
        ("assert add(1, 10000000000000) > 0", "integer_literal_too_large"),
        ("assert 1 == 1", "target_entry_point_not_called"),
    ],
)
def test_policy(code, reason):
    assert pycode.candidate_reason(code, "add").startswith(reason) and bool(pycode.candidate_reason(code, "add")) == bool(reason)


def test_policy_entry_point():
    assert pycode.candidate_reason("assert add(1)", "not a name") == "invalid_entry_point"


def test_identity_ignores_layout():
    assert pycode.group_identity(GOLD, "add") == pycode.group_identity("def add(a,b):  # sum\n  return (a+b)\n", "add")
    assert pycode.group_identity(GOLD, "add") != pycode.group_identity(GOLD, "sub")
    assert pycode.group_identity("def", "x") is None


def test_mutants_parse_and_differ():
    code = 'def f(xs):\n    """a + b"""\n    for i in range(len(xs)):\n        if xs[-1] <= i and True:\n            return i + 1\n    return []\n'
    found = pycode.mutants(code)
    kinds = {k for _, k, _ in found}
    assert {"arithmetic", "comparison", "logical", "boolean", "index", "off_by_one", "return"} <= kinds
    assert all(pycode.semantic(m) and m != code and '"""a + b"""' in m for _, _, m in found)
    assert len({m for _, _, m in found}) == len(found)
    assert pycode.mutants("x = 1") == []


def test_assertions():
    assert pycode.assertions("def check(candidate):\n    assert candidate(1) == 2\n    assert candidate(1)==2\n", "f") == ["assert f(1) == 2"]


def test_classify():
    got = sandbox.classify(["assert add(1, 2) == 3", "assert add(0, 0) == 0", "assert add(1, 1) == 5"], GOLD, GOLD.replace("+", "-"))
    assert [(v, k) for _, v, k, _ in got] == [(True, True), (True, False), (False, False)]


def test_endless_loop_ends():
    start = time.time()
    got = sandbox.classify(["assert f() == 1"], "def f():\n    while True:\n        pass\n", "def f():\n    return 1\n", 0.3)
    assert got[0][1:] == (False, False, "TIMEOUT") and time.time() - start < 5


def test_source_policy():
    assert sandbox.source_violations("from typing import List\n") == []
    assert sandbox.source_violations("import os\n") == ["source_import_not_allowed:os"]
    assert sandbox.classify(["assert f()"], "import os\ndef f(): return 1", "def f(): return 1")[0][3] == "source_import_not_allowed:os"


EVERY_FORM = """
@d
async def f(a, /, b: int = 1, *c, k=None, **e) -> None:
    async with x as y, z: yield
    return [i async for i in a if i], {**b, 'k': 1}, {1, 2}, f"{a!r:>{k}} {b=}", b"\\x00", 1.5e300j, ..., -0.0
class C[T: int, *U, **V](B, metaclass=M):
    '''text'''
    type A[T] = list[T]
    x: int
try: pass
except* (E, F) as e: raise G from None
else: global q
match v:
    case None | True: del a[1:, ::2]
    case {"k": [1, *_], **r} if (n := r): pass
    case P(1, y=-1): assert n, None
for i, *j in (): break
else: (lambda *, a: (yield a))(*i, **j)
import a.b as c; from .. import d; x = y = 'it\\'s "q" \\ud800'; z @= not w
"""


@pytest.mark.parametrize("code", [EVERY_FORM, "", "None", "x = ()", "def f(): return", open(ast.__file__).read()])
def test_trees_as_text_are_those_of_the_library(code):
    assert pycode.dumped(ast.parse(code)) == ast.dump(ast.parse(code)) == pycode.semantic(code)


def test_short_sources_are_remembered():
    seen = []
    found = pycode.remembered(lambda source: seen.append(source) or len(seen))
    long = "x" * (pycode.SHORT + 1)
    assert [found(s) for s in ("a", "a", None, None, long, long)] == [1, 1, 2, 3, 4, 5]
