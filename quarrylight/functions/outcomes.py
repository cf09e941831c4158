"""Outcomes, generations and budgets as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.pycode import policy_column

# What a message of a failed launch says when credit has run out.
CREDIT = r"(?is)(insufficient|exceeded|out of).{0,40}(credit|budget|balance|quota)|(credit|spend).{0,20}limit"


def status(ok: Column, error: Column) -> Column:
    """PASS, TIMEOUT, FAIL or ERROR, from whether a run succeeded and its error text."""
    text = F.coalesce(error, F.lit(""))
    return F.when(ok, "PASS").when(text.contains("TIMEOUT"), "TIMEOUT").when(text.contains("AssertionError"), "FAIL").otherwise("ERROR")


def same_outcome(ok_a: Column, ok_b: Column, error_a: Column, error_b: Column, value_a: Column, value_b: Column) -> Column:
    """Both succeed with equal values, or both fail with the same type of error."""
    return (ok_a == ok_b) & F.when(ok_a, value_a.eqNullSafe(value_b)).otherwise(error_a.eqNullSafe(error_b))


def usable_line(text: Column) -> Column:
    """The line of a generation that may be a test: the first that begins with `assert `, else the first that assigns a result
    or an output or holds brackets and a =, else the first that is not blank. A blank generation is empty."""
    lines = F.transform(F.split(_stripped(text), "\n"), _stripped)
    first = lambda keep: F.try_element_at(F.filter(lines, keep), F.lit(1))
    holds = lambda x, part: F.contains(x, F.lit(part))
    assigned = first(lambda x: x.startswith("result = ") | x.startswith("output = ") | (holds(x, "(") & holds(x, ")") & holds(x, "=")))
    return F.coalesce(first(lambda x: x.startswith("assert ")), assigned, first(lambda x: x != ""), F.lit(""))


def generated(generations: DataFrame, ident: str, text: str, entry_point: str) -> DataFrame:
    """(ident, test, valid, reason): the usable line of each generation, and why the policy refuses it; a line that it allows is valid."""
    rows = generations.select(ident, entry_point, usable_line(F.coalesce(F.col(text), F.lit(""))).alias("test"))
    judged = rows.withColumn("reason", policy_column(F.col("test"), F.col(entry_point)))
    return judged.select(ident, "test", (F.col("reason") == "").alias("valid"), "reason")


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def json_safe(value: Column, kind: Column) -> Column:
    """{value} if it is one that JSON has, else {repr, type}, with at most 2,000 characters of it."""
    plain = kind.isin("int", "float", "str", "bool", "NoneType")
    return F.to_json(F.struct(F.when(plain, value).alias("value"), F.when(~plain, F.substring(value, 1, 2000)).alias("repr"), F.when(~plain, kind).alias("type")))


def schedule(rows: Column, epochs: int, batch: int, accumulation: int, warmup: int, checkpoint: int) -> Column:
    """How a run of an optimiser goes: rows of padding, steps an epoch and in all, warm-up steps and checkpoints."""
    step = batch * accumulation
    per = F.ceil(rows / step)
    total = per * epochs
    return F.struct(F.pmod(-rows, F.lit(step)).alias("padding"), per.alias("steps_per_epoch"), total.alias("steps"), F.least(F.lit(warmup), F.greatest(total - 1, F.lit(0))).cast("long").alias("warmup"), F.floor(total / checkpoint).alias("checkpoints"))


def labels_of(prompt: Column, completion: Column, masked: int = -100) -> Column:
    """Token labels: the prompt's masked, the completion's its own."""
    return F.concat(F.array_repeat(F.lit(masked).cast("long"), F.size(prompt)), completion)


def credit_failure(message: Column, remaining: Column, reserve: float) -> Column:
    return F.coalesce(message.rlike(CREDIT), F.lit(False)) | F.coalesce(remaining <= reserve, F.lit(False))


# How a prompt is made shorter, and what a run's numbers are where they aren't recorded.
COMPACTION = "head_tail_preserve_chat_suffix_v1"
RUN_DEFAULTS = {"balanced_sampling_enabled": "false", "synthetic_balance_fraction": "0.0", "max_synthetic_repeats": "2", "lr_scheduler_type": "cosine", "min_function_kill_rate": "0.5"}


def training_scope(limit: Column, stage: Column, mode: Column, completion: int = 1536, prompt: int = 512, generation: int = 128, repository: int = 1024) -> Column:
    """What the supervised stage of a run trains on, as text. A bound on pairs counts only where that stage runs; null or 0 is no bound."""
    bound = F.when(stage & (limit > 0), limit)
    scope = F.coalesce(F.concat(F.lit("first_"), bound.cast("string"), F.lit("_train_records:bounded_selection=stratified_generation_compatible_v2")), F.lit("full_train_split"))
    fields = [
        ("execution_mode", F.coalesce(F.nullif(mode, F.lit("")), F.lit("all"))), ("repository_completion_limit", F.lit(str(completion))), ("prompt_token_limit", F.lit(str(prompt))), ("prompt_compaction", F.lit(COMPACTION)),
        ("generation_completion_limit", F.lit(str(generation))), ("repository_generation_completion_limit", F.lit(str(repository))),
    ]
    return F.concat_ws(":", scope, *(F.concat(F.lit(f"{n}="), v) for n, v in fields))


def dataset_fingerprint(corpus: Column, scope: Column, frozen: Column, stage: Column) -> Column:
    """The fingerprint of a corpus and a scope; where the supervised stage doesn't run, the frozen one that is on record, which
    must be of the same corpus (another one raises). corpus is `<id>:<schema version>:<records' digest>:<splits' digest>:`."""
    kept = F.trim(frozen, F.lit(" \t\r\n"))
    foreign = F.raise_error(F.concat(F.lit("the recorded fingerprint is of another corpus: "), kept)).cast("string")
    return F.when(stage | frozen.isNull(), F.concat(corpus, F.lit("sft_scope="), scope)).otherwise(F.when(kept.startswith(corpus), kept).otherwise(foreign))


def with_run_defaults(recorded: Column) -> Column:
    """A run's recorded numbers (map of strings) with defaults for those that older runs didn't record."""
    given = F.coalesce(recorded, F.create_map().cast("map<string,string>"))
    defaults = F.create_map(*(F.lit(x) for pair in RUN_DEFAULTS.items() for x in pair))
    return F.map_concat(given, F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)))


def selector_parts(selector: Column) -> Column:
    """{path, names, target, parameter} of a test selector."""
    parts = F.split(selector, "::")
    bare = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.regexp_replace(x, r"\[.*\]$", ""))
    return F.struct(F.element_at(parts, 1).alias("path"), F.array_join(bare, ".").alias("names"), F.try_element_at(bare, F.lit(-1)).alias("target"), F.nullif(F.regexp_extract(selector, r"\[(.*)\]$", 1), F.lit("")).alias("parameter"))


def function_name(code: Column) -> Column:
    """The first defined function's name, or unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(code, r"def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(", 1), F.lit("")), F.lit("unknown"))


def parameter_kinds(signature: Column) -> Column:
    """The kinds of a signature's parameters, by their hints; int without one. Commas in brackets do not part parameters."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"\[[^\[\]]*\]", ""), r"\[[^\[\]]*\]", "")
    kind = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_extract(x, r":\s*([A-Za-z_.]+)", 1), "^typing\\.", "")))
    named = F.filter(F.transform(F.split(flat, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin("self", "cls", "*", "/"))
    return F.transform(named, lambda x: F.when(kind(x).isin("list", "sequence", "tuple", "set"), "list").when(kind(x) == "str", "str").when(kind(x) == "float", "float").when(kind(x) == "bool", "bool").when(kind(x).isin("dict", "mapping"), "dict").otherwise("int"))


def doubling_length(target: int, unit: int) -> int:
    """How many units reach a target length: doubled until it is passed, then halved in between."""
    if target <= 0 or unit <= 0:
        return 0
    high = 1
    while high * unit < target:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle * unit < target else (low, middle)
    return high if math.ceil(target / unit) else 0
