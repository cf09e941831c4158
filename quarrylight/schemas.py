"""Schemas of the record tables."""

from __future__ import annotations

FUNCTIONS = "id string, source string, code string, signature string, entry_point string, docstring string, test_cases array<string>, category string, complexity_score int"
MUTATION_PAIRS = "id string, source string, golden_code string, mutant_code string, entry_point string, mutation_type string, mutation_description string, test_cases array<string>"
TESTS = "array<struct<code:string,oracle:string,format:string>>"
RECORDS = (
    "schema_version int, id string, task_type string, language string, group_id string, code_under_test string, reference_code string, entry_point string, "
    f"specification string, content_hash string, source struct<name:string,upstream:string>, tests {TESTS}, "
    "provenance struct<project:string,repository:string,mutation_type:string,category:string,official_task_id:string>, quality struct<execution_mode:string,test_count:int>"
)
SPLITS = "train array<string>, val array<string>, test array<string>"
TASKS = "id string, source string, project_group string, status string, training_record_ids array<string>"
EXCLUSIONS = "record_id string, reason string, completion_tokens array<int>, completion_token_limit int"
HUMANEVAL = "task_id string, prompt string, canonical_solution string, test string, entry_point string"
MBPP = "task_id string, text string, code string, test_list array<string>, challenge_test_list array<string>"
BUGS = "project string, bug_id string, description string, buggy_code string, fixed_code string, test_cases string, category string, entry_point string"
EXAMPLES = "prompt string, completion string, function_id string, project string, bug_family string, semantic_group string, execution_mode string"
