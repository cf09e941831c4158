import json
import random

from pyspark.sql import functions as F
from test_records import repository

from quarrylight.operators import audits, corpus

IDENTITY = {"dataset": "d", "split": "test", "source_parquet_sha256": "s"}


def payload(i, record=None, status="accepted", **changes):
    return {"schema_version": 1, "summary": {"instance_id": f"i{i}", "status": status, "reason": None if status == "accepted" else "why"}, "source_identity": {**IDENTITY, "instance_id": f"i{i}"}, "record": record} | changes


def evidenced(i, reference="return 1", test="x = 1", spec="s", f2p=2, **evidence):
    found = {"buggy_fail_verified": True, "fixed_pass_verified": True, "base_counts": {"f2p_failure": f2p, "f2p_success": 0, "p2p_failure": 0, "p2p_success": 1}, "fixed_counts": {"f2p_failure": 0, "f2p_success": f2p, "p2p_failure": 0, "p2p_success": 1}, "base_log_sha256": f"b{i}", "fixed_log_sha256": f"f{i}"} | evidence
    provenance = {"project": "p", "fail_to_pass": ["t"] * f2p, "pass_to_pass": ["u"], "official_test_evidence": found}
    return repository(i, code_under_test="def f():\n    return 0\n", reference_code=f"def f():\n    {reference}\n", specification=spec, tests=[{"code": test, "oracle": corpus.TEST_ORACLE, "format": "unittest_fragment"}], provenance=provenance)


def plain(rows, baseline):
    """Routes one payload after another."""
    known, prompts = {b["supervision_key"] for b in baseline}, {}
    for b in baseline:
        prompts.setdefault(b["prompt_key"], set()).add(b["reference_key"])
    new, mine, out = set(), {}, []
    for _, p in rows:
        f = corpus.facts_of(p["record"])
        refs = prompts.get(f["prompt_key"], set()) | mine.get(f["prompt_key"], set())
        if f["supervision_key"] in known:
            out.append("duplicate_semantic_supervision_baseline")
        elif f["supervision_key"] in new:
            out.append("duplicate_semantic_supervision_selected_results")
        elif refs and refs != {f["reference_key"]}:
            out.append("conflicting_semantic_supervision")
        else:
            new.add(f["supervision_key"])
            mine.setdefault(f["prompt_key"], set()).add(f["reference_key"])
            out.append(None)
    return out


def audit(spark, rows, baseline=(), logs=None, limit=50):
    payloads = spark.createDataFrame([(n, p if isinstance(p, str) or p is None else json.dumps(p)) for n, p in rows], "nth long, payload string")
    base = spark.createDataFrame([tuple(b[k] for k in ("id", "prompt_key", "supervision_key", "reference_key")) for b in baseline], "record_id string, prompt_key string, supervision_key string, reference_key string")
    held = spark.createDataFrame(logs if logs is not None else [(f"i{i}", f"b{i}", f"f{i}") for i in range(200)], "instance_id string, base string, fixed string")
    return {r["nth"]: tuple(r)[1:] for r in audits.audited_results(payloads, base, held, IDENTITY, F.length, limit).collect()}


def test_what_is_no_result(spark):
    ok = evidenced(1)
    bad = [
        ("{", "unsupported_schema"), (None, "unsupported_schema"), (payload(1, schema_version=2), "unsupported_schema"), (payload(1, summary={}), "missing_instance"), (payload(1, ok, source_identity={}), "source_identity"),
        (payload(1, ok, status="excluded"), "exclusion_payload"), (payload(1, {**ok, "content_hash": "x"}), "record_schema_or_hash"), (payload(1, None), "record_schema_or_hash"), (payload(1, evidenced(1, reference="return (")), "does_not_parse"),
        (payload(1, evidenced(1, test="def (")), "does_not_parse"), (payload(1, evidenced(1, f2p=0)), "evidence"), (payload(1, evidenced(1, buggy_fail_verified=None)), "evidence"), (payload(1, evidenced(1, base_counts={})), "evidence"), (payload(1, evidenced(1, base_log_sha256="x")), "evidence_logs"),
    ]
    numbered = [json.loads(json.dumps(p).replace('"i1"', f'"i{i}"')) if isinstance(p, dict) else p for i, (p, _) in enumerate(bad)]
    got = audit(spark, list(enumerate(numbered)), logs=[(f"i{i}", "b1", "f1") for i in range(50)])
    assert [got[i][2:] for i in range(len(bad))] == [("invalid", reason, None) for _, reason in bad]


def test_routes_equal_one_by_one(spark):
    rng = random.Random(5)
    make = lambda i: evidenced(i, f"return {rng.randrange(2) + 1}", f"x = {rng.randrange(3)}", f"s{rng.randrange(6)}")
    baseline = [corpus.facts_of(make(i + 500)) for i in range(4)]
    rows = [(i, payload(i, make(i))) for i in range(80)]
    got = audit(spark, rows, baseline)
    want = plain(rows, baseline)
    assert [got[i][3] for i in range(80)] == want and len(set(want)) == 4
    assert all(got[i][2] == ("accepted" if w is None else "audit_excluded") for i, w in enumerate(want))


def test_exclusions_repeats_and_long_tests(spark):
    rows = [(0, payload(1, evidenced(1))), (1, payload(1, evidenced(1))), (2, payload(2, None, status="excluded")), (3, payload(3, evidenced(3, test="x = '" + "y" * 60 + "'", spec="other")))]
    got = audit(spark, rows)
    assert [got[i][2:] for i in range(4)] == [("accepted", None, True), ("invalid", "repeated_instance", None), ("excluded", "why", None), ("accepted", None, False)]
    assert audit(spark, []) == {}


def test_what_is_not_accepted_is_excluded(spark):
    assert audit(spark, [(0, payload(1, None, status=None)), (1, payload(2, None, status="other"))]) == {n: (f"i{n + 1}", None, "excluded", "why", None) for n in (0, 1)}


def test_rows_are_dealt_out_before_payloads_are_made_and_no_side_is_broadcast(spark, sf_dir, monkeypatch):
    from quarrylight.plans import catalogue

    dealt = []
    frame = type(spark.range(0))
    before = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: dealt.append(set(self.columns)) or before(self, *a))
    found = catalogue.queries()["result_audit"](spark, sf_dir)
    assert len(dealt) == 2 and all({"o_orderkey"} <= c or {"c_custkey"} <= c for c in dealt)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInPandas" not in plan


def test_behaviour(spark):
    golden = "def f(x):\n    return x + 1\n"
    rows = [(1, golden, golden.replace("+", "-"), ["assert f(1) == 2"]), (2, golden, golden, ["assert f(1) == 2"]), (3, golden, golden.replace("+", "-"), ["assert f(1) == 2", "assert f(1) == 3"]), (4, "while True:\n    pass\n", golden, ["assert f(1)"]), (5, golden, golden, []), (6, None, None, None)]
    df = spark.createDataFrame(rows, "id int, golden_code string, mutant_code string, test_cases array<string>")
    assert {r["id"]: r["reason"] for r in audits.behaving(df, 0.3).collect()} == {1: "ok", 2: "surviving_mutant", 3: "golden_fixture_failure", 4: "behavior_timeout", 5: "surviving_mutant", 6: "surviving_mutant"}


def test_conditions_of_a_stored_result(spark):
    ids = ("a", "b")
    good = {"dataset_fingerprint": "x", "adapter": "sft_adapter", "evaluation_split": "val", "final_test_measurement": False, "seed": 42, "tests_per_function": 8, "function_kill_rate": 1.0, "candidate_kill_rate": 0, "function_validation_records": 2, "repository_validation_records_held": 3}
    rows = [good, good | {"seed": 1, "adapter": None}, good | {"function_kill_rate": 1.5, "candidate_kill_rate": "no"}, good | {"final_test_measurement": True, "evaluation_scope_sha256": "z"}, good | {"function_validation_records": 1, "repository_validation_records_held": None}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "{"), (10, None)], "i int, r string")
    got = {r["i"]: r["f"] for r in df.select("i", audits.result_faults(F.col("r"), audits.Expected("x", function_ids=ids, repository_records=3)).alias("f")).collect()}
    assert got[0] == [] and got[1] == ["adapter", "seed"] and set(got[2]) >= {"function_kill_rate", "candidate_kill_rate"} and got[3] == ["test_split_unused", "function_scope"] and got[4] == ["function_count", "repository_count"]
    assert "readable" in got[9] and "fingerprint" in got[10]
