"""The gate of a canonical corpus: records as JSON texts, splits, exclusions and the external index against named rules.

Each record is parsed once, in one pass that gives facts: what its JSON and its syntax trees say. Rules are queries over the
table of facts; an empty result is the approval.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.pycode import canonical_json, compiles, dumped, semantic, sha256, tree_identity
from quarrylight.operators.lineage import checkpointed, shuffled
from quarrylight.sources.sinks import file_digests

# The record format.
FIELDS = ("schema_version", "id", "task_type", "language", "source", "group_id", "code_under_test", "reference_code", "entry_point", "specification", "tests", "provenance", "quality", "content_hash")
FUNCTION_MODE = "function_assertion"
REPOSITORY_TASKS = {"repository_pytest_fragment": ("official_repository_pytest_reproduction", "official_repository_swebench_reproduction"), "repository_unittest_fragment": ("official_repository_unittest_reproduction",)}
TEST_FORMATS = {"repository_pytest_fragment": "pytest_fragment", "repository_unittest_fragment": "unittest_fragment"}
SWEBENCH_TASK = "official_repository_swebench_reproduction"
TEST_ORACLE = "fixed_passes_buggy_fails_repository"
SPLITS = ("train", "val", "test")
LOCKED = ("locked_external_eval_not_materialized", "verified_repository_eval_only")
MATERIALISED = "materialized_for_training"
CORPUS_FILES = ("records.json", "splits.json", "external_eval_index.json")


@dataclass(frozen=True)
class Gate:
    """Which rules a corpus' manifest asks for, beside those that always hold."""

    semantic_groups: bool = True
    deduplicated: bool = True
    conflicts: bool = True
    locked: bool = True


FACTS = (
    "id string, whole boolean, versioned boolean, hashed boolean, parsed boolean, mode string, task_type string, entry_point string, evidence boolean, project string, repository string, group_id string, "
    "defined boolean, identity string, tests int, malformed boolean, oracle boolean, compiled boolean, prompt_key string, supervision_key string, reference_key string, official_task string"
)
_NAMES = [f.split()[0] for f in FACTS.split(", ")]


def content_hash(record: dict) -> str:
    """The hash of a record's canonical JSON, all fields but the hash itself."""
    return sha256(canonical_json({k: v for k, v in record.items() if k != "content_hash"}))


def supervision_keys(record: dict, mode: str, target: str | None, reference: str | None, tests: list[str | None]) -> tuple[str, str] | None:
    """(prompt, supervision): hashes of what a record asks and of that with its answer and tests, by their syntax trees; None if a part has none."""
    if None in (target, reference, *tests):
        return None
    text = re.sub(r"\s+", " ", record.get("specification") or "").strip()
    prompt = {"execution_mode": mode, "target_ast": target, "entry_point": record.get("entry_point") or "", "specification": text}
    return sha256(canonical_json(prompt)), sha256(canonical_json({**prompt, "reference_ast": reference, "test_asts": sorted(tests)}))


def _defined(tree: ast.Module, name: str) -> bool:
    """Whether a function of a name is defined anywhere; most are found at the top, without a walk."""
    made = lambda n: isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name
    return any(map(made, tree.body)) or any(map(made, ast.walk(tree)))


def facts(text: str | None) -> dict:
    """What a record says of itself. A text that isn't a record with all fields has no facts but its id, if any."""
    try:
        return facts_of(json.loads(text or ""))
    except ValueError:
        return facts_of(None)


def facts_of(record: object) -> dict:
    """The facts of a parsed record."""
    out: dict = dict.fromkeys(_NAMES)
    if not isinstance(record, dict):
        return {**out, "whole": False}
    out["id"] = record["id"] if isinstance(record.get("id"), str) else None
    parts = {k: record.get(k) if isinstance(record.get(k), dict) else {} for k in ("quality", "provenance")}
    out["whole"] = all(f in record for f in FIELDS) and all(isinstance(record[f], str) for f in ("id", "code_under_test", "reference_code"))
    if not out["whole"]:
        return out
    quality, provenance = parts["quality"], parts["provenance"]
    mode, entry = quality.get("execution_mode", FUNCTION_MODE), record["entry_point"] or ""
    try:
        tree = ast.parse(record["code_under_test"])
    except (SyntaxError, ValueError):
        tree = None
    reference = semantic(record["reference_code"])
    tests = record["tests"] if isinstance(record["tests"], list) else []
    codes = [t["code"] for t in tests if isinstance(t, dict) and isinstance(t.get("code"), str)]
    keys = supervision_keys(record, mode, dumped(tree) if tree else None, reference, [semantic(c) for c in codes]) if len(codes) == len(tests) else None
    expected = TEST_FORMATS.get(mode)
    return out | {
        "versioned": record["schema_version"] == 1 and record["language"] == "python",
        "hashed": content_hash(record) == record["content_hash"],
        "parsed": tree is not None and reference is not None,
        "mode": mode,
        "task_type": record["task_type"],
        "entry_point": entry,
        "evidence": bool(quality.get("official_targeted_test_fixed_pass_buggy_fail")),
        "project": (provenance.get("project") or "").lower(),
        "repository": (provenance.get("repository") or "").lower(),
        "group_id": record["group_id"],
        "defined": bool(tree and entry) and _defined(tree, entry),
        "identity": tree_identity(reference, entry),
        "tests": len(tests),
        "malformed": len(codes) < len(tests),
        "oracle": expected is None or all(isinstance(t, dict) and t.get("format") == expected and t.get("oracle") == TEST_ORACLE for t in tests),
        "compiled": all(map(compiles, codes)),
        "prompt_key": keys[0] if keys else None,
        "supervision_key": keys[1] if keys else None,
        "reference_key": sha256(reference) if reference is not None else None,
        "official_task": provenance.get("official_task_id") or None,
    }


@contextmanager
def quiet() -> Iterator[None]:
    """What the sources of a batch make the parser warn of is not said."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        yield


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        with quiet():
            rows = [facts(t) for t in batch["record"]]
        yield pd.DataFrame(rows, columns=_NAMES).astype({"tests": "Int32"})


def record_facts(records: DataFrame) -> DataFrame:
    """The facts of each record, a JSON text in column `record`."""
    return records.select(F.col("record").cast("string").alias("record")).mapInPandas(_facts, FACTS)


def _record_rules(gate: Gate) -> list[tuple[str, Column]]:
    """(rule, broken) for each rule that a record breaks by itself."""
    c = F.col
    sound, repository = c("parsed"), c("mode").isin(*REPOSITORY_TASKS)
    function = sound & (c("mode") == FUNCTION_MODE)
    allowed = reduce(Column.__or__, [(c("mode") == m) & c("task_type").isin(*tasks) for m, tasks in REPOSITORY_TASKS.items()])
    rules = [
        ("schema_or_language", ~c("versioned")),
        ("content_hash", ~c("hashed")),
        ("invalid_python", ~sound),
        ("unknown_mode", ~(repository | (c("mode") == FUNCTION_MODE))),
        ("task_type", sound & repository & ~allowed),
        ("standalone_entry_point", sound & repository & (c("entry_point") != "")),
        ("no_evidence", sound & repository & ~c("evidence")),
        ("entry_point_missing", function & ~c("defined")),
        ("no_tests", c("tests") == 0),
        ("malformed_test", c("malformed")),
        ("test_oracle", ~c("oracle")),
        ("test_does_not_compile", ~c("compiled")),
    ]
    if gate.semantic_groups:
        same = c("project") == F.element_at(F.split("repository", "/"), -1)
        rules += [
            ("swebench_project", sound & repository & (c("task_type") == SWEBENCH_TASK) & ((c("repository") == "") | ~same)),
            ("project_group", sound & repository & ((c("project") == "") | (c("group_id") != F.concat(F.lit("project:bugsinpy:"), "project")))),
            ("function_group", function & ~c("group_id").eqNullSafe(c("identity"))),
        ]
    return rules


def corpus_violations(records: DataFrame, splits: DataFrame, exclusions: DataFrame, index: DataFrame, gate: Gate | None = None) -> DataFrame:
    """(rule, id) of every broken rule over records (record: a JSON text), splits (split, id), exclusions (record_id) and the
    external index (id, status, training_record_ids).

    Rules that need a whole record are not asked of one that lacks fields (malformed_record). Rules between records name the
    smallest id of those concerned, rules between splits the group or project, rules of the index the task. A null exclusion
    is named ''. Nothing is collected.
    """
    gate = gate or Gate()
    every = checkpointed(record_facts(records))
    whole = every.filter("whole")
    named = lambda rule, df, key: df.select(F.lit(rule).alias("rule"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"))
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in _record_rules(gate))))
    ids = every.filter("id IS NOT NULL").select("id").distinct()
    counted = splits.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    placed = whole.join(shuffled(splits), "id").select("id", "split", "group_id", "project", "mode")
    many = lambda df, key: df.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1")
    parts = [
        named("malformed_record", every.filter("NOT whole"), "id"),
        whole.select(F.explode(broken).alias("rule"), "id"),
        named("repeated_id", every.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "id"),
        named("split_names", splits.filter(~F.col("split").isin(*SPLITS)), "split"),
        named("record_in_no_split", ids.join(shuffled(splits), "id", "left_anti"), "id"),
        named("split_repeated_id", counted.filter("n > 1"), "id"),
        named("split_unknown_id", counted.join(shuffled(ids), "id", "left_anti"), "id"),
        named("exclusion_unknown", exclusions.join(shuffled(ids), F.col("record_id") == F.col("id"), "left_anti"), "record_id"),
        named("group_in_two_splits", many(placed, "group_id"), "group_id"),
        named("project_in_two_splits", many(placed.filter(F.col("mode").isin(*REPOSITORY_TASKS)), "project"), "project"),
    ]
    if gate.deduplicated:
        parts.append(named("repeated_supervision", whole.filter("supervision_key IS NOT NULL").groupBy("supervision_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n > 1"), "id"))
    if gate.conflicts:
        parts.append(named("conflicting_references", whole.filter("prompt_key IS NOT NULL").groupBy("prompt_key").agg(F.count_distinct("reference_key").alias("n"), F.min("id").alias("id")).filter("n > 1"), "id"))
    if gate.locked:
        trained = whole.filter("official_task IS NOT NULL").groupBy(F.col("official_task").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("trained"))
        tasks = index.join(shuffled(trained), "id", "left")
        declared = F.array_sort(F.array_distinct(F.coalesce("training_record_ids", F.array().cast("array<string>"))))
        differ = F.col("trained").isNull() | ((F.size(declared) > 0) & (declared != F.col("trained")))
        parts += [named("locked_task_in_training", tasks.filter(F.col("status").isin(*LOCKED) & F.col("trained").isNotNull()), "id"), named("materialised_ids_differ", tasks.filter((F.col("status") == MATERIALISED) & differ), "id")]
    return reduce(DataFrame.unionByName, parts).distinct()


def manifest_violations(spark: SparkSession, folder: str) -> DataFrame:
    """(rule, id) of a corpus folder against its manifest.json, which is one small text: its version, its approval, and the
    recorded digests of its files. A file that isn't there differs."""
    schema = "schema_version int, quality_gate struct<all_training_records_verified:boolean>, files map<string,struct<sha256:string>>"
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.from_json("value", schema).alias("m")).select("m.*")
    verified = F.coalesce(F.col("quality_gate.all_training_records_verified"), F.lit(False))
    flags = manifest.select(F.explode(F.array_compact(F.array(F.when(~F.col("schema_version").eqNullSafe(F.lit(1)), "manifest_version"), F.when(~verified, "manifest_unverified")))).alias("rule"), F.lit("manifest.json").alias("id"))
    wanted = manifest.select(F.explode(F.array_union(F.array(*map(F.lit, CORPUS_FILES)), F.coalesce(F.array_intersect(F.map_keys("files"), F.array(F.lit("training_exclusions.json"))), F.array().cast("array<string>")))).alias("id"), "files")
    recorded = wanted.select("id", F.try_element_at("files", F.col("id"))["sha256"].alias("recorded"))
    found = file_digests(spark, folder).select(F.col("name").alias("id"), "sha256")
    differ = recorded.join(found, "id", "left").filter(~F.coalesce(F.col("recorded") == F.col("sha256"), F.lit(False)))
    return flags.unionByName(differ.select(F.lit("file_differs").alias("rule"), "id"))
