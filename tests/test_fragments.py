import ast

import pytest

from quarrylight.functions import parts as P
from quarrylight.operators import fragments as G

BUGGY = '''import os
from math import (
    sqrt,
)

LIMIT = 3


def outer(x):
    # a comment
    return x + 1


@decorated
class Box(Base):
    """What it is."""

    width = 2
    height: int = 3

    def area(self):
        return self.width * self.height

    @property
    def name(self):
        return "box"


def same():
    return 1
'''
FIXED = BUGGY.replace("x + 1", "x - 1").replace("self.width * self.height", "self.width * self.height + 0").replace("# a comment", "# another")

TESTS = '''import unittest


class Base(unittest.TestCase):
    shared = 1

    def helper(self):
        return self.deeper()

    def deeper(self):
        return self.shared

    def test_inherited(self):
        self.helper()
        self.hook()

    def hook(self):
        pass

    def unused(self):
        pass


class Derived(Base):
    own = 2

    def setUp(self):
        self.prepare()

    def prepare(self):
        pass

    def hook(self):
        self.extra()

    def extra(self):
        pass

    def idle(self):
        pass


class Other:
    def test_twice(self):
        pass


def test_twice():
    pass


@mark
def test_alone():
    assert Derived
'''


def test_parts_keep_places():
    found = P.parts(BUGGY)
    assert [(p["kind"], p["name"]) for p in found] == [("import", None), ("import", None), ("def", "outer"), ("class", "Box"), ("field", None), ("field", None), ("def", "area"), ("def", "name"), ("def", "same")]
    box = found[3]
    assert box["text"] == "@decorated\nclass Box(Base):\n" and box["bases"] == ["Base"] and found[4]["owner"] == box["nth"] and found[7]["text"] == '    @property\n    def name(self):\n        return "box"\n'
    assert found[6]["refs"] == ["height", "width"] and P.parts("def (") is None and P.parts(None) == []


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, path string, buggy string, fixed string")


def test_only_changed_definitions_stay(spark):
    r = G.changed_definitions(pairs(spark, [(1, "a.py", BUGGY, FIXED)])).first()
    head = "import os\nfrom math import (\n    sqrt,\n)\n"
    box = '@decorated\nclass Box(Base):\n    width = 2\n    height: int = 3\n    def area(self):\n        return self.width * self.height{}\n'
    assert r["compact"]
    assert r["buggy"] == head + box.format("") + "def outer(x):\n    # a comment\n    return x + 1\n"
    assert r["fixed"] == head + box.format(" + 0") + "def outer(x):\n    # another\n    return x - 1\n"


def test_whole_sources_stay_where_nothing_can_be_told(spark):
    comment = BUGGY.replace("# a comment", "# another")
    rows = [(1, "a", BUGGY, comment), (2, "a", BUGGY, "def ("), (3, "a", None, FIXED), (4, "a", "x = 1\n", "x = 2\n"), (5, "a", "", "")]
    got = {r["id"]: (r["buggy"], r["fixed"], r["compact"]) for r in G.changed_definitions(pairs(spark, rows)).collect()}
    assert got == {i: (b, f, False) for i, _, b, f in rows}
    assert G.changed_definitions(pairs(spark, [])).count() == 0


def test_added_and_removed_definitions(spark):
    old, new = "class A:\n    def f(self):\n        return 1\n", "class A:\n    def f(self):\n        return 1\n\ndef g():\n    return 2\n\nclass B:\n    def h(self):\n        return 3\n"
    r = G.changed_definitions(pairs(spark, [(1, "a", old, new)])).first()
    assert (r["buggy"], r["fixed"]) == ("\n", "class B:\n    def h(self):\n        return 3\ndef g():\n    return 2\n")
    r = G.changed_definitions(pairs(spark, [(1, "a", "class A:\n    x = 1\n\n    def f(self): return 1\n", "class A:\n    x = 1\n")])).first()
    assert r["fixed"] == "class A:\n    x = 1\n" and r["buggy"].endswith("def f(self): return 1\n")


def test_context_of_a_repository(spark):
    rows = [(1, "b.py", "def f():\n    return 1\n", "def f():\n    return 2\n"), (1, "a.py", "def g():\n    return 1\n", "def g():\n    return 3\n"), (1, "c.py", "x = 1\n", "x = 1\n"), (1, "d.py", "def (", "x = 1\n"), (2, "e.py", "x = 1\n", None)]
    got = G.repository_context(pairs(spark, rows)).collect()
    assert [tuple(r) for r in got] == [(1, "# File: a.py\ndef g():\n    return 1\n\n# File: b.py\ndef f():\n    return 1\n", "# File: a.py\ndef g():\n    return 3\n\n# File: b.py\ndef f():\n    return 2\n", ["a.py", "b.py"])]


def reach(source, owner, names):
    """Names that a class's methods reach from some of them, one call after another."""
    node = next(n for n in ast.parse(source).body if isinstance(n, ast.ClassDef) and n.name == owner)
    methods = {n.name: n for n in node.body if isinstance(n, ast.FunctionDef)}
    seen, waiting = set(), [n for n in names if n in methods]
    while waiting:
        if (n := waiting.pop()) not in seen:
            seen.add(n)
            waiting += [x.attr for x in ast.walk(methods[n]) if isinstance(x, ast.Attribute) and getattr(x.value, "id", "") == "self" and x.attr in methods]
    return seen


@pytest.mark.parametrize("names", [["Base", "test_inherited"], ["test_inherited"], ["Derived", "test_inherited"], ["test_alone"], ["test_twice"], ["Other", "test_alone"], ["Other", "test_inherited"], ["missing"]])
def test_fragments_hold_what_a_test_reaches(spark, names):
    asked = spark.createDataFrame([(1, 0, "t.py", names)], "id long, nth int, path string, names array<string>")
    text = G.test_fragments(asked, spark.createDataFrame([(1, "t.py", TESTS)], "id long, path string, source string")).first()["fragment"]
    if names in (["test_twice"], ["Other", "test_alone"], ["Other", "test_inherited"], ["missing"]):
        assert text is None
        return
    if names == ["test_alone"]:
        assert text == "@mark\ndef test_alone():\n    assert Derived\n"
        return
    kept = {n.name: {m.name for m in n.body if isinstance(m, ast.FunctionDef)} for n in ast.parse(text).body}
    want = {"Base": reach(TESTS, "Base", ["test_inherited"])}
    if names[0] == "Derived":
        shared = {"hook"}
        want["Derived"] = reach(TESTS, "Derived", ["setUp", "helper", "hook", *shared])
    assert kept == want and "unused" not in text and "shared = 1" in text


def test_each_test_once(spark):
    rows = [(1, 0, "def a():\n    pass\n"), (1, 1, None), (1, 2, "\ndef a():\n    pass\n\n"), (1, 3, "def b():\n    pass\n")]
    got = G.distinct_tests(spark.createDataFrame(rows, "id long, nth int, fragment string")).orderBy("pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "def a():\n    pass\n"), (1, 1, "def b():\n    pass\n")]


def test_closure(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{(i * 7 + 3) % 40}") for i in range(40)] + [(2, "n0", "n1")], "k int, node string, to string")
    got = {(r["k"], r["node"]) for r in G.closure(spark.createDataFrame([(1, "n0"), (2, "n1"), (2, "n0")], "k int, node string"), edges, ["k"]).collect()}
    at, want = 0, set()
    while (1, f"n{at}") not in want:
        want.add((1, f"n{at}"))
        at = (at * 7 + 3) % 40
    assert got == want | {(2, "n0"), (2, "n1")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_changed_definitions_is_broadcast(spark):
    pairs = spark.createDataFrame([(1, "a.py", BUGGY, FIXED)], "id long, path string, buggy string, fixed string")
    assert "Broadcast" not in plan_of(G.changed_definitions(pairs))


def test_no_side_of_repository_context_is_broadcast(spark):
    pairs = spark.createDataFrame([(1, "a.py", BUGGY, FIXED)], "id long, path string, buggy string, fixed string")
    assert "Broadcast" not in plan_of(G.repository_context(pairs))
