import json

import pytest

from quarrylight.functions import outcomes, pycode
from quarrylight.operators import corpus, findings, ledger, records


def record(i, **changes):
    """A sound function record, as a dict with its hash."""
    reference = f"def f{i}(x):\n    return x + {i}\n"
    out = {
        "schema_version": 1, "id": f"r{i}", "task_type": "mutation", "language": "python", "source": {"name": "s"}, "code_under_test": reference.replace("+", "-"), "reference_code": reference, "entry_point": f"f{i}",
        "specification": "é " + "x" * 3, "tests": [{"code": f"assert f{i}(1) == {i + 1}", "oracle": "reference", "format": "assert"}], "provenance": {"weight": 1.5, "none": None}, "quality": {}, "group_id": pycode.group_identity(reference, f"f{i}"),
    }
    out |= changes
    return {**out, "content_hash": corpus.content_hash(out)}


def repository(i, **changes):
    """A sound repository record."""
    base = {
        "task_type": "official_repository_unittest_reproduction", "entry_point": "", "group_id": f"project:bugsinpy:p{i}", "provenance": {"project": f"P{i}", "official_task_id": f"t{i}"},
        "quality": {"execution_mode": "repository_unittest_fragment", "official_targeted_test_fixed_pass_buggy_fail": True}, "tests": [{"code": "class A:\n    pass\n", "oracle": corpus.TEST_ORACLE, "format": "unittest_fragment"}],
    }
    return record(i, **{**base, **changes})


def rules(spark, rows, splits=None, exclusions=(), index=(), gate=None):
    texts = spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "record string")
    placed = [(r["id"], "train") for r in rows if isinstance(r, dict)] if splits is None else splits
    frames = (spark.createDataFrame(placed, "id string, split string"), spark.createDataFrame([(x,) for x in exclusions], "record_id string"), spark.createDataFrame(list(index), "id string, status string, training_record_ids array<string>"))
    return {(r["rule"], r["id"]) for r in corpus.corpus_violations(texts, *frames, gate).collect()}


def test_a_sound_corpus_passes(spark):
    rows = [record(i) for i in range(4)] + [repository(9)]
    assert rules(spark, rows, exclusions=["r1"], index=[("t9", corpus.MATERIALISED, ["r9"]), ("t8", corpus.LOCKED[1], None)]) == set()
    assert rules(spark, [], []) == set()


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        (record(1, schema_version=2), "schema_or_language"),
        (record(1) | {"content_hash": "x"}, "content_hash"),
        (record(1, reference_code="def ("), "invalid_python"),
        (record(1, quality={"execution_mode": "other"}), "unknown_mode"),
        (record(1, entry_point="g", group_id=pycode.group_identity(record(1)["reference_code"], "g")), "entry_point_missing"),
        (record(1, group_id="x"), "function_group"),
        (record(1, tests=[]), "no_tests"),
        (record(1, tests=[{"code": 5}]), "malformed_test"),
        (record(1, tests=["x"]), "malformed_test"),
        (record(1, tests=[{"code": "assert ("}]), "test_does_not_compile"),
        (record(1, tests=[{"code": "return 1"}]), "test_does_not_compile"),
        (repository(1, task_type="official_repository_pytest_reproduction"), "task_type"),
        (repository(1, entry_point="f1"), "standalone_entry_point"),
        (repository(1, quality={"execution_mode": "repository_unittest_fragment"}), "no_evidence"),
        (repository(1, provenance={"project": "Q"}), "project_group"),
        (repository(1, tests=[{"code": "x = 1", "oracle": corpus.TEST_ORACLE, "format": "assert"}]), "test_oracle"),
    ],
)
def test_each_rule_of_a_record(spark, row, rule):
    assert rules(spark, [row, record(5)]) == {(rule, "r1")}


def test_records_that_are_none(spark):
    lacking = {k: v for k, v in record(1).items() if k != "specification"}
    assert rules(spark, ["[1]", "{", None, lacking], [("r1", "train")]) == {("malformed_record", ""), ("malformed_record", "r1")}
    swe = repository(2, task_type=corpus.SWEBENCH_TASK, quality={"execution_mode": "repository_pytest_fragment", "official_targeted_test_fixed_pass_buggy_fail": True}, tests=[{"code": "", "oracle": corpus.TEST_ORACLE, "format": "pytest_fragment"}])
    assert rules(spark, [swe]) == {("swebench_project", "r2")}
    sound = {**swe, "provenance": {"project": "p2", "repository": "Org/P2"}}
    assert rules(spark, [{**sound, "content_hash": corpus.content_hash(sound)}]) == set()


def test_rules_between_records(spark):
    a = record(1)
    layout = record(1, id="s1", code_under_test=a["code_under_test"] + "# a comment\n", specification="é\n  xxx ")
    assert rules(spark, [a, layout]) == {("repeated_supervision", "r1")}
    assert rules(spark, [a, layout], gate=corpus.Gate(deduplicated=False)) == set()
    other = "def f1(x):\n    return x * 1\n"
    two = record(1, id="s1", reference_code=other, group_id=pycode.group_identity(other, "f1"))
    assert rules(spark, [a, two]) == {("conflicting_references", "r1")}
    more_tests = record(1, id="s1", tests=a["tests"] + [{"code": "assert f1(2) == 3", "oracle": "", "format": ""}])
    assert rules(spark, [a, more_tests], [("r1", "train"), ("s1", "val")]) == {("group_in_two_splits", a["group_id"])}
    p, q = repository(1), repository(2, group_id="project:bugsinpy:p1", provenance={"project": "p1"})
    assert rules(spark, [p, q], [("r1", "train"), ("r2", "test")]) == {("group_in_two_splits", "project:bugsinpy:p1"), ("project_in_two_splits", "p1")}
    assert rules(spark, [a, a], [("r1", "train"), ("r1", "val"), ("x", "new")], ["y", None]) == {
        ("repeated_id", "r1"), ("repeated_supervision", "r1"), ("split_repeated_id", "r1"), ("split_unknown_id", "x"), ("split_names", "new"), ("exclusion_unknown", "y"), ("exclusion_unknown", ""), ("group_in_two_splits", a["group_id"]),
    }
    assert rules(spark, [p], index=[("t1", corpus.LOCKED[0], None)]) == {("locked_task_in_training", "t1")}
    assert rules(spark, [p], index=[("t1", corpus.MATERIALISED, []), ("t2", corpus.MATERIALISED, []), ("t3", "other", [])]) == {("materialised_ids_differ", "t2")}


def test_the_manifest(spark, tmp_path):
    import hashlib

    files = {n: {"sha256": hashlib.sha256(b"[]\n").hexdigest()} for n in corpus.CORPUS_FILES}
    for n in files:
        (tmp_path / n).write_bytes(b"[]\n")
    manifest = lambda **k: (tmp_path / "manifest.json").write_text(json.dumps({"schema_version": 1, "quality_gate": {"all_training_records_verified": True}, "files": files} | k))
    found = lambda: {tuple(r) for r in corpus.manifest_violations(spark, str(tmp_path)).collect()}
    manifest()
    assert found() == set()
    manifest(schema_version=2, quality_gate={}, files={**files, "training_exclusions.json": {"sha256": "x"}})
    assert found() == {("manifest_version", "manifest.json"), ("manifest_unverified", "manifest.json"), ("file_differs", "training_exclusions.json")}
    manifest(files={})
    assert {i for r, i in found() if r == "file_differs"} == set(corpus.CORPUS_FILES)


def test_a_missing_key_fails_the_lookup(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, 10)], "k int, w int")
    assert [tuple(r) for r in ledger.strict_lookup(left.limit(1), right, "k").collect()] == [(1, "a", 10)]
    with pytest.raises(Exception, match="no k 2 in the lookup"):
        ledger.strict_lookup(left, right, "k").collect()


def test_unknown_ids_fail_a_selection(spark):
    ids, known = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r["id"] for r in ledger.selected(ids, known, "id", "n").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="unknown id b"):
        ledger.selected(ids, known.filter("id = 'a'"), "id", "n").collect()


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "k string, m double")
    assert ledger.best_and_worst(none, "k", "m").isEmpty()
    assert ledger.best_and_worst(spark.createDataFrame([("a", 1.0)], none.schema), "k", "m").isEmpty()
    assert tuple(ledger.best_and_worst(spark.createDataFrame([("b", 0.0), ("a", 0.0)], none.schema), "k", "m").first()) == (None, "a", 0.0)
    assert ledger.diverse(none, "k", 5, ["m"]).isEmpty()
    pairs = spark.createDataFrame([("1", None, None, None, None, None)], "id string, golden_code string, mutant_code string, mutation_type string, test_cases array<string>, entry_point string")
    assert tuple(records.pair_audit(pairs).first()) == ("1", "unknown", ["IDENTICAL", "NO_TESTS", "NO_ENTRY"])


def test_lengths_are_found_by_doubling():
    for unit in (1, 3, 7):
        for target in range(0, 60):
            assert outcomes.doubling_length(target, unit) == -(-target // unit)


def test_findings_and_coverage():
    source = "def f(x, items=[]):\n    if x > 0:\n        return 1\n    return 0\n"
    found, share = findings.analyse(source, "f", ["assert f(1) == 1", "assert f(1) == 2"], None)
    assert ("confirmed", "contract", "assert f(1) == 2") in found and ("observation", "static", "mutable_default") in found and share == 1.0
    found, share = findings.analyse("def f(x):\n    while True:\n        pass\n", "f", [], None, limit=1, timeout=0.2)
    assert found == [("potential", "TIMEOUT", "f(0)")] and share > 0
    assert findings.analyse(None, None, [], None) == ([("observation", "no_entry_point", "")], 0.0)
    assert findings.analyse("import os\ndef f(): pass\n", "f", [], None)[0] == [("observation", "not_run", "source_import_not_allowed:os")]


def test_no_side_of_the_gate_is_broadcast(spark):
    from quarrylight.operators import corpus

    records_ = spark.createDataFrame([("{}",)], "record string")
    splits = spark.createDataFrame([("train", "a")], "split string, id string")
    index = spark.createDataFrame([("t", "s", ["a"])], "id string, status string, training_record_ids array<string>")
    found = corpus.corpus_violations(records_, splits, spark.createDataFrame([("a",)], "record_id string"), index)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_source_of_a_record_is_parsed_once(monkeypatch):
    import ast

    from quarrylight.operators import corpus

    one = record(977)
    parsed, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda source, *a: parsed.append(source) or parse(source, *a))
    corpus.facts_of(one)  # making its group_id has parsed the reference
    assert sorted(parsed) == sorted([one["code_under_test"], one["tests"][0]["code"]])
    parsed.clear()
    corpus.facts_of({**one, "code_under_test": "x = 977\n"})
    assert parsed == ["x = 977\n"]


def test_records_are_dealt_out_before_they_are_parsed(spark, sf_dir, monkeypatch):
    from quarrylight.plans import ledgers

    dealt = []
    frame = type(spark.range(0))
    before = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(a) or before(self, *a))
    ledgers.planted_corpus(spark, sf_dir)
    assert dealt == [(spark.sparkContext.defaultParallelism,)]


def test_functions_at_the_top_are_found_without_a_walk(monkeypatch):
    import ast

    from quarrylight.operators import corpus

    record = dict.fromkeys(corpus.FIELDS) | {"id": "1", "code_under_test": "def f(x):\n    return x\n", "reference_code": "x", "entry_point": "f", "tests": []}
    nested = record | {"code_under_test": "class A:\n    async def f(self):\n        pass\n"}
    assert corpus.facts_of(nested)["defined"] and not corpus.facts_of(record | {"entry_point": "g"})["defined"]
    monkeypatch.setattr(ast, "walk", lambda tree: 1 / 0)
    assert corpus.facts_of(record)["defined"]
