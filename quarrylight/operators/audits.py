"""Audits before results count: pairs by their behaviour, stored validation results by their conditions, and result payloads by
identity, record, evidence and what the corpus already holds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.corpus import facts_of, quiet
from quarrylight.operators.lineage import checkpointed, shuffled
from quarrylight.operators.sandbox import classify
from quarrylight.operators.staging import failures

# ---- behaviour


def behaviour_reason(golden: str, mutant: str, tests: list[str], timeout: float = 0.5) -> str:
    """ok if every test passes on the golden code and one fails on the mutant; else why not."""
    rows = classify(tests, golden, mutant, timeout)
    errors = [e for *_, e in rows]
    if rows and all(e == "TIMEOUT" for e in errors):
        return "behavior_timeout"
    if any(e.startswith("WORKER") for e in errors):
        return "worker_exception"
    if any(not valid for _, valid, _, _ in rows):
        return "golden_fixture_failure"
    return "ok" if any(killed for _, _, killed, _ in rows) else "surviving_mutant"


def behaving(pairs: DataFrame, timeout: float = 0.5) -> DataFrame:
    """(id, reason) of pairs (id, golden_code, mutant_code, test_cases), each in a process of its own. Null code is empty; a pair
    without tests keeps its mutant alive."""

    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for golden, mutant, tests in batches:
            yield pd.Series([behaviour_reason(g or "", m or "", [] if t is None else list(t), timeout) for g, m, t in zip(golden, mutant, tests, strict=True)])

    return pairs.select("id", F.pandas_udf(check, "string")("golden_code", "mutant_code", "test_cases").alias("reason"))


# ---- stored results

_RESULT = (
    "dataset_fingerprint string, adapter string, evaluation_split string, final_test_measurement boolean, seed long, tests_per_function long, function_kill_rate double, candidate_kill_rate double, "
    "function_validation_records long, evaluation_scope_sha256 string, repository_validation_records_held long"
)


@dataclass(frozen=True)
class Expected:
    """What a stored validation result must have been measured on. None asks nothing."""

    fingerprint: str
    seed: int = 42
    tests_per_function: int = 8
    adapter: str = "sft_adapter"
    split: str = "val"
    function_ids: tuple[str, ...] | None = None
    repository_records: int | None = None


def _rate(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(0.0, 1.0)


def result_faults(result: Column, expected: Expected) -> Column:
    """array<string>: the conditions that a stored result, a JSON text, fails before it may be compared with; null fails them all.

    A recorded digest of the functions must be that of the expected ids in their order; one that isn't recorded passes.
    """
    import hashlib

    r = F.from_json(F.coalesce(result, F.lit("")), _RESULT)
    rules = [
        ("readable", F.try_parse_json(result).isNotNull()),
        ("fingerprint", r["dataset_fingerprint"] == expected.fingerprint),
        ("adapter", r["adapter"] == expected.adapter),
        ("split", r["evaluation_split"] == expected.split),
        ("test_split_unused", ~r["final_test_measurement"]),
        ("seed", r["seed"] == expected.seed),
        ("tests_per_function", r["tests_per_function"] == expected.tests_per_function),
        ("function_kill_rate", _rate(r["function_kill_rate"])),
        ("candidate_kill_rate", _rate(r["candidate_kill_rate"])),
    ]
    if expected.function_ids is not None:
        scope = hashlib.sha256(json.dumps(list(expected.function_ids), separators=(",", ":")).encode()).hexdigest()
        rules += [("function_count", r["function_validation_records"] == len(expected.function_ids)), ("function_scope", F.coalesce(r["evaluation_scope_sha256"] == scope, F.lit(True)))]
    if expected.repository_records is not None:
        rules.append(("repository_count", r["repository_validation_records_held"] == expected.repository_records))
    return failures(rules)


# ---- result payloads

_PAYLOAD = "instance_id string, status string, reason string, fault string, record_id string, prompt_key string, supervision_key string, reference_key string, codes array<string>, base_log string, fixed_log string"
_NAMES = [f.split()[0] for f in _PAYLOAD.split(", ")]
_COUNTS = ("f2p_failure", "f2p_success", "p2p_failure", "p2p_success")


def _evidence_holds(provenance: dict) -> bool:
    """Whether the target tests failed before the fix and pass after it, and the others passed all along, in the numbers expected."""
    found = provenance.get("official_test_evidence") or {}
    f2p, p2p = (len(provenance.get(k) or []) for k in ("fail_to_pass", "pass_to_pass"))
    counts = [[(found.get(side) or {}).get(k) for k in _COUNTS] for side in ("base_counts", "fixed_counts")]
    return f2p > 0 and found.get("buggy_fail_verified") is True and found.get("fixed_pass_verified") is True and counts == [[f2p, 0, 0, p2p], [0, f2p, 0, p2p]]


def payload_facts(text: str | None, identity: dict[str, str]) -> dict:
    """What a result payload says; fault is the first thing that makes it no result at all."""
    try:
        payload = json.loads(text or "")
    except ValueError:
        payload = None
    out: dict = dict.fromkeys(_NAMES)
    if not isinstance(payload, dict) or payload.get("schema_version") != 1:
        return {**out, "fault": "unsupported_schema"}
    summary, record = payload.get("summary") or {}, payload.get("record")
    out |= {"instance_id": summary.get("instance_id"), "status": summary.get("status"), "reason": summary.get("reason")}
    if not out["instance_id"]:
        return {**out, "fault": "missing_instance"}
    if (payload.get("source_identity") or {}) != {**identity, "instance_id": out["instance_id"]}:
        return {**out, "fault": "source_identity"}
    if out["status"] != "accepted":
        return {**out, "fault": None if out["reason"] and record is None else "exclusion_payload"}
    found = facts_of(record)
    if not found["whole"] or not found["hashed"]:
        return {**out, "fault": "record_schema_or_hash"}
    if not found["parsed"] or not found["compiled"]:
        return {**out, "fault": "does_not_parse"}
    if not found["tests"] or found["malformed"]:
        return {**out, "fault": "no_tests"}
    provenance = record["provenance"] if isinstance(record["provenance"], dict) else {}
    evidence = provenance.get("official_test_evidence") or {}
    return out | {
        "fault": None if _evidence_holds(provenance) else "evidence", "record_id": found["id"], "codes": [t["code"].strip() for t in record["tests"]],
        "base_log": evidence.get("base_log_sha256"), "fixed_log": evidence.get("fixed_log_sha256"), **{k: found[k] for k in ("prompt_key", "supervision_key", "reference_key")},
    }


def audited_results(payloads: DataFrame, baseline: DataFrame, logs: DataFrame, identity: dict[str, str], tokens: Callable[[Column], Column], limit: int) -> DataFrame:
    """(instance_id, record_id, route, reason, eligible) of result payloads (nth, payload: a JSON text), in the order of nth.

    baseline: the keys that the corpus holds (record_id, prompt_key, supervision_key, reference_key). logs: digests of the
    evidence files (instance_id, base, fixed). tokens makes a count of a test's text.

    invalid: no result at all, an instance that came before, or evidence whose logs are missing or differ. excluded: the run
    said why. audit_excluded: its supervision is in the baseline or came before, or its prompt has another reference. Of a
    prompt that the baseline doesn't know the first sound result counts, and later ones with its reference. An accepted record
    with a test of `limit` tokens or more stays, but isn't eligible for training.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            with quiet():
                rows = pd.DataFrame([payload_facts(t, identity) for t in batch["payload"]], columns=_NAMES)
            rows.insert(0, "nth", batch["nth"].to_numpy())
            yield rows

    read_ = checkpointed(payloads.select(F.col("nth").cast("long").alias("nth"), F.col("payload").cast("string").alias("payload")).mapInPandas(read, f"nth long, {_PAYLOAD}"))
    firsts = read_.filter("instance_id IS NOT NULL").groupBy("instance_id").agg(F.min("nth").alias("first"))
    held = logs.select("instance_id", "base", "fixed").dropDuplicates(["instance_id"])
    rows = read_.join(shuffled(firsts), "instance_id", "left").join(shuffled(held), "instance_id", "left")
    accepted = F.col("status").eqNullSafe(F.lit("accepted"))
    lost = accepted & ~(F.coalesce(F.col("base") == F.col("base_log"), F.lit(False)) & F.coalesce(F.col("fixed") == F.col("fixed_log"), F.lit(False)))
    fault = F.coalesce("fault", F.when(F.col("first") < F.col("nth"), "repeated_instance"), F.when(lost, "evidence_logs"))
    rows = checkpointed(rows.withColumn("fault", fault).drop("first", "base", "fixed", "base_log", "fixed_log"))
    keys = checkpointed(baseline.select("record_id", "prompt_key", "supervision_key", "reference_key"))
    known = keys.groupBy("supervision_key").agg(F.min("record_id").alias("same"))
    prompts = keys.groupBy("prompt_key").agg(F.min("reference_key").alias("low"), F.max("reference_key").alias("high"))
    fit = F.forall("codes", lambda c: tokens(F.concat(c, F.lit("<|endoftext|>"))) < limit)
    sound = rows.filter(F.col("fault").isNull() & accepted).select("nth", "instance_id", "record_id", fit.alias("fit"), "prompt_key", "supervision_key", "reference_key")
    own = sound.join(shuffled(known), "supervision_key", "left").join(shuffled(prompts), "prompt_key", "left")
    leads = own.filter("same IS NULL").groupBy("prompt_key").agg(F.min_by("reference_key", "nth").alias("lead"))
    fits = own.join(shuffled(leads), "prompt_key", "left").withColumn("fits", F.when(F.col("low").isNotNull(), (F.col("low") == F.col("high")) & (F.col("low") == F.col("reference_key"))).otherwise(F.col("lead") == F.col("reference_key")))
    takers = fits.filter("same IS NULL AND fits").groupBy("supervision_key").agg(F.min("nth").alias("taker"))
    audit = F.when(F.col("same").isNotNull(), "duplicate_semantic_supervision_baseline").when(F.col("taker") < F.col("nth"), "duplicate_semantic_supervision_selected_results").when(~F.col("fits"), "conflicting_semantic_supervision")
    judged = fits.join(shuffled(takers), "supervision_key", "left").withColumn("reason", audit)
    counted = judged.select("nth", "instance_id", "record_id", F.when(F.col("reason").isNull(), "accepted").otherwise("audit_excluded").alias("route"), "reason", F.when(F.col("reason").isNull(), F.col("fit")).alias("eligible"))
    route = F.when(F.col("fault").isNotNull(), "invalid").otherwise("excluded").alias("route")
    others = rows.filter(F.col("fault").isNotNull() | ~accepted).select("nth", "instance_id", "record_id", route, F.coalesce("fault", "reason").alias("reason"), F.lit(None).cast("boolean").alias("eligible"))
    return counted.unionByName(others)
