"""Swaps, mutation pairs, candidate calls, tests made of calls, and the search for calls: against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import pycode
from quarrylight.operators import candidates as C
from quarrylight.operators import coverage as V
from quarrylight.operators import mutation, swaps

SOURCE = '''def f(a, b=10):
    # a + b - c
    if a <= b and not a == 3:
        return a + b ** 2
    while a < 5:
        a += 1
        print("x + y", 'it\\'s', a // 2 % 3)
    for i in range(n):
        b[:n], c[k:] = [1], []
    text = "True"
    return None
'''


def frame(spark, rows, schema="id long, code string"):
    return spark.createDataFrame(rows, schema)


def plain_places(code, text):
    return [m.start() for m in re.finditer(re.escape(text), code)]


def outside(code, at):
    before = code[:at]
    odd = lambda q: (before.count(q) - before.count("\\" + q) - 3 * before.count(q * 3)) % 2 == 1
    return not ("#" in before.rsplit("\n", 1)[-1] or odd("'") or odd('"'))


def test_operators_stand_where_they_are_said_to(spark):
    rows = swaps.swaps(frame(spark, [(1, SOURCE), (2, ""), (3, None), (4, "x = '''a + b''' + c\n")]), "id", "code").orderBy("id", "nth").collect()
    code = {1: SOURCE, 4: "x = '''a + b''' + c\n"}
    assert all(code[r["id"]][r["offset"] :].startswith(r["original"]) and r["line"] == code[r["id"]][: r["offset"]].count("\n") + 1 for r in rows)
    for i, text in code.items():
        for kind, table in zip(swaps.KINDS, (swaps.ARITHMETIC, swaps.COMPARISON, swaps.LOGICAL), strict=False):
            want = [(p, a, b) for a, b in table for p in plain_places(text, a) if outside(text, p)]
            assert [(r["offset"], r["original"], r["replacement"]) for r in rows if r["id"] == i and r["kind"] == kind] == want
    others = [(r["kind"], r["original"], r["replacement"]) for r in rows if r["id"] == 1 and r["kind"] in swaps.KINDS[3:]]
    assert ("boundary_value", "10", "11") in others and ("boundary_value", "10", "9") in others and ("boundary_value", "range(n)", "range(n - 1)") in others
    assert ("boundary_value", "[:n]", "[:n-1]") in others and ("boundary_value", "[k:]", "[k+1:]") in others
    assert ("return_value", "return None", "return 0") in others and ("return_value", "return None", "return []") in others and ("return_value", "return a + b ** 2", "return None") in others
    assert ("condition_negation", "if a <= b and not a == 3:", "if not (a <= b and not a == 3):") in others and ("condition_negation", "while a < 5:", "while not a < 5:") in others


def test_what_does_not_stand_there_raises(spark):
    one = frame(spark, [(1, "return   x\n")])
    row = swaps.swaps(one, "id", "code").filter("kind = 'return_value'").join(one, "id")
    with pytest.raises(Exception, match="at offset 0"):
        row.select(swaps.applied(F.col("code"), F.col("offset"), F.col("original"), F.col("replacement"))).collect()


def test_diverse_mutants_keep_the_places_of_those_that_do_not_parse(spark):
    functions = frame(spark, [(1, SOURCE), (2, "def g(a):\n    return a + 1\n"), (3, "x")])
    every = swaps.swaps(functions, "id", "code").groupBy("id").count().collect()
    got = swaps.diverse_mutants(functions, "id", "code", 12).orderBy("id", "place").collect()
    assert all(r["id"] and pycode.semantic(r["mutant_code"]) for r in got)
    own = [r for r in got if r["id"].startswith("1_")]
    assert {r["kind"] for r in own} == set(swaps.KINDS) and max(r["place"] for r in own) <= 12 and all(r["id"] == f"1_mutant_{r['place']:03d}" for r in own)
    small = {r["id"]: r["count"] for r in every}[2]
    assert small <= 12 and [r["place"] for r in got if r["id"].startswith("2_")] == sorted(r["place"] for r in got if r["id"].startswith("2_"))
    again = swaps.diverse_mutants(functions.repartition(5), "id", "code", 12).orderBy("id", "place").collect()
    assert got == again


def test_diverse_mutants_are_made_where_their_functions_are(spark, sf_dir):
    from quarrylight.plans import catalogue

    plan = catalogue.queries()["diverse_mutants"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_pairs_reach_the_target_at_any_number_of_partitions(spark):
    rows = [(i, f"def f{i}(a, b):\n    total = a + b\n    return total * {i + 2}\n") for i in range(20)] + [(50, "tiny"), (51, None)]
    functions = frame(spark, rows).withColumn("at", F.col("id") * 2)
    first = {i: pycode.described_mutants(c) for i, c in rows}
    total = sum(map(len, first.values()))
    for target in (1, 7, total, total + 13, total + 1000):
        got = mutation.generate_pairs(functions.repartition(1 + target % 5), "id", "at", "code", target).orderBy("seq").collect()
        second = sum(min(5, len(m)) for m in first.values() if len(m) >= 2)
        assert len(got) == min(target, total + second) and [r["seq"] for r in got] == list(range(1, len(got) + 1))
        for r in got:
            name = "mut" if r["seq"] <= total else "cmp"
            assert r[1] == f"{r[2]}_{name}_{r['seq']:05d}"
            one = {(t, d, m) for _, t, d, m in first[r[2]]}
            if name == "mut":
                assert (r["mutation_type"], r["description"], r["mutant_code"]) in one
            else:
                d1, d2 = r["description"].split(" AND ")
                starts = [m for _, _, d, m in first[r[2]][:5] if d == d1]
                assert r["mutation_type"] == "compound" and any((d, m) == (d2, r["mutant_code"]) for s in starts for _, _, d, m in pycode.described_mutants(s))
    ids = [r[2] for r in mutation.generate_pairs(functions, "id", "at", "code", total).orderBy("seq").collect()]
    assert ids == sorted(ids)
    assert mutation.generate_pairs(functions.limit(0), "id", "at", "code", 5).count() == 0


@pytest.mark.parametrize(
    ("how", "code", "want"),
    [
        (C.RUNNER, "def f(a, b: str, c: List[int], d: float = 1.0, self=2): pass", ["any", "str", "list", "float", "any"]),
        (C.RUNNER, "def f(): pass", []),
        (C.RUNNER, "x = 1", []),
        (C.TEMPLATES_READ, "def f(self, a: dict, b: Dict[str, int]): pass", ["dict", "str", "any"]),
        (C.TEMPLATES_READ, "def f(): pass", []),
        (C.TEMPLATES_READ, "x = 1", ["any"]),
        (C.SEARCH_READ, "def f(a: int,\n b: bool): pass", ["any"]),
        (C.SEARCH_READ, "def f(a: int, b: bool): pass", ["int", "bool"]),
    ],
)
def test_kinds(spark, how, code, want):
    df = spark.createDataFrame([(code, "f")], "code string, entry string")
    assert df.select(C.kinds(F.col("code"), F.col("entry"), how)).first()[0] == want


def test_productions(spark):
    df = spark.createDataFrame([("def f(a: List[int], b: Optional[str] = None, c: Tuple[int]): pass", "f")], "code string, entry string")
    a, b, c = df.select(C.productions(F.col("code"), F.col("entry"))).first()[0]
    assert a == C.GRAMMAR["list_int"] and b == [*C.GRAMMAR["str"], "None"] and c == C.GRAMMAR["tuple"]


def test_products_by_rank(spark):
    rows = [(i, f"f{i}", [list("abcde"[: 1 + (i + j) % 5]) for j in range(i)]) for i in range(6)] + [(9, "f9", [["1", "2"]] * 40)]
    functions = spark.createDataFrame(rows, "id long, entry string, v array<array<string>>")
    got = {}
    for r in C.product_calls(functions, "id", "entry", "v", 7).orderBy("id", "nth").collect():
        got.setdefault(r["id"], []).append(r["call"])
    for i, entry, v in rows:
        assert got[i] == [f"result = {entry}({', '.join(x)})" for x in itertools.islice(itertools.product(*v), 7)]
    for i, _, v in rows:
        calls = [r["call"] for r in C.product_calls(functions.filter(F.col("id") == i), "id", "entry", "v", 7, seed=3).collect()]
        total = 1
        for x in v:
            total *= len(x)
        assert len(calls) == len(set(calls)) == min(7, total)
    more = C.topped_up(C.product_calls(functions.filter("id < 3"), "id", "entry", "v", 9), functions, "id", "entry", "v", 9, 1).groupBy("id").agg(F.count("*"), F.sort_array(F.collect_list("nth"))).collect()
    assert all(r[1] == 9 and r[2] == list(range(9)) for r in more)


def test_calls_become_tests(spark):
    code = "def f(a, b):\n    if a == 0:\n        return None\n    return [a // b, 'x']\n\ndef g(a):\n    return a * 2\n"
    calls = ["result = f(4, 2)", "result = f(0, 1)", "result = f(1, 0)", "result = g(1.5)", "output = g('a')", "while True: pass", "f(1, 1)"]
    df = spark.createDataFrame([(1, code, i, c) for i, c in enumerate(calls)] + [(2, "import os\n", 0, "result = 1")], "id long, code string, nth int, call string")
    got = {(r["id"], r["nth"]): (r["ok"], r["test"]) for r in V.asserted(df, "id", "code", "nth", "call", 0.3).collect()}
    assert got == {
        (1, 0): (True, "assert f(4, 2) == [2, 'x']"), (1, 1): (True, "result = f(0, 1)"), (1, 2): (False, "result = f(1, 0)"), (1, 3): (True, "assert g(1.5) == 3.0"),
        (1, 4): (True, "assert output = g('a') == 'aa'"), (1, 5): (False, "while True: pass"), (1, 6): (True, "f(1, 1)"), (2, 0): (False, "result = 1"),
    }


def test_lines_and_branches():
    code = "def f(x):\n    if x > 0:\n        return 1\n    return 2\n"
    a, b = V.run_calls(code, ["f(1)", "f(0)"])
    assert a["lines"] == [2, 3] and b["lines"] == [2, 4] and a["arcs"] == [2 * V.ARC + 3] and b["arcs"] == [2 * V.ARC + 4]


@pytest.mark.parametrize("by", ["coverage", "output"])
def test_search_reaches_more_and_repeats_itself(spark, by):
    code = "def f(x, y):\n    if x > 60:\n        return 'big'\n    if y == 'a':\n        if x < -20:\n            return 'low'\n        return 'a'\n    return x % 4\n"
    seeds = ['result = f(50, "a")', 'result = f(-15, "b")', "result = f(", "result = f(1)"]
    functions = spark.createDataFrame([(i, code, seeds if i < 3 else []) for i in range(4)], "id long, code string, seeds array<string>")
    rows = {steps: V.explore(functions, "id", "code", "seeds", 6, steps=steps, by=by, timeout=0.3).orderBy("id").collect() for steps in (0, 40)}
    for less, more in zip(rows[0], rows[40], strict=True):
        assert set(less["lines"]) <= set(more["lines"]) and set(less["arcs"]) <= set(more["arcs"]) and less["tests"] == more["tests"][: len(less["tests"])]
    assert any(len(m["lines"]) > len(k["lines"]) for k, m in zip(rows[0], rows[40], strict=True)) and rows[40][3]["tests"] == [] and all(len(r["tests"]) <= 6 for r in rows[40])
    again = V.explore(functions.repartition(3), "id", "code", "seeds", 6, steps=40, by=by, timeout=0.3).orderBy("id").collect()
    assert again == rows[40]


def test_changes_keep_calls_calls():
    rng = random.Random(4)
    call = 'result = f(-3, [1, 2], "a", True, x1)'
    made = {V.varied(call, rng) for _ in range(300)}
    assert call in made and len(made) > 40 and all("x1" in c for c in made)


BRANCHING = '''def f(n, m):
    total = 0
    for i in range(n):
        if i == m:
            break
        elif i > 3:
            total += 2
            continue
        total += 1
    while total > 10:
        total -= 5
    else:
        total += 0
    try:
        total = 1 // m
    except ZeroDivisionError:
        if n:
            total = -1
    with_else = 0
    if total: with_else = 1
    else:
        with_else = 2
    return with_else
'''


def test_branches_are_those_that_runs_can_take():
    possible = set(V.possible_branches(BRANCHING, "f"))
    rng = random.Random(1)
    runs = V.run_calls(BRANCHING, [f"f({rng.randrange(12)}, {rng.randrange(20)})" for _ in range(120)])
    taken = {a for r in runs for a in r["arcs"]}
    lines = {a // V.ARC for a in possible}
    assert lines == {3, 4, 6, 10, 17, 20} and possible <= taken
    assert {a for a in taken if a // V.ARC in lines} - possible <= {20 * V.ARC + 23, 3 * V.ARC + 10}
    assert V.possible_branches("def (", "f") == V.possible_branches(None, None) == V.possible_branches("x = 1", "f") == []


def test_missing_branches(spark):
    code = "def f(x):\n    if x > 1:\n        return 1\n    if x < 0:\n        x = 0\n    return x\n"
    df = spark.createDataFrame([(1, code, "f", ["f(0)"]), (2, code, "f", ["f(2)", "f(-1)", "f(0)"]), (3, "def f():\n    return 1\n", "f", []), (4, None, None, None)], "id int, code string, entry string, calls array<string>")
    got = {r["id"]: (r["branches"], r["reached"], [tuple(m) for m in r["missing"]]) for r in V.branch_coverage(df, "id", "code", "entry", "calls").collect()}
    assert got == {1: (4, 2, [(2, 3), (4, 5)]), 2: (4, 4, []), 3: (0, 0, []), 4: (0, 0, [])}


def test_pair_names_are_those_of_the_sql_at_any_number(spark):
    import duckdb

    from quarrylight.plans.programs import _pair_name

    rows = [(7, "arithmetic", 9), (8, "compound", 99_999), (9, "compound", 100_000), (9, "arithmetic", 123_456)]
    df = spark.createDataFrame(rows, "id long, kind string, seq long")
    got = [r["name"] for r in df.select(_pair_name(F.col("id"), F.col("kind"), F.col("seq")).alias("name")).collect()]
    kinds = {"arithmetic": "mut", "compound": "cmp"}
    assert got == [duckdb.execute(f"SELECT {i} || '_{kinds[k]}_' || lpad('{n}', 5, '0')").fetchone()[0] for i, k, n in rows]


@pytest.mark.parametrize("name", ["diverse_mutants", "operator_swaps", "pair_audit", "task_commands", "result_conditions", "repository_fragments"])
def test_rows_are_dealt_out_before_the_work(spark, sf_dir, name, monkeypatch):
    from quarrylight.plans import catalogue

    asked = []
    frame = type(spark.range(0))
    before = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: asked.append(a) or before(self, *a))
    catalogue.queries()[name](spark, sf_dir)
    assert (spark.sparkContext.defaultParallelism,) in asked
