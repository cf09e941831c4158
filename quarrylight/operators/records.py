"""Canonical records as flat rows, tests that compile or are short enough, and the audit of mutation pairs."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Execution modes.
FUNCTION_MODE = "function_assertion"
REPOSITORY_MODES = ("repository_pytest_fragment", "repository_unittest_fragment")


def _or(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def flatten(records: DataFrame) -> DataFrame:
    """Canonical records as flat rows. Empty strings count as missing; a record without project is synthetic."""
    p, q = F.col("provenance"), F.col("quality")
    return records.select(
        "id",
        _or(q["execution_mode"], F.lit(FUNCTION_MODE)).alias("execution_mode"),
        _or(p["project"], p["repository"], F.lit("synthetic")).alias("project"),
        _or(p["mutation_type"], p["category"], F.col("task_type")).alias("bug_family"),
        "group_id",
        "entry_point",
        F.col("code_under_test").alias("mutant_code"),
        F.col("reference_code").alias("golden_code"),
        F.transform("tests", lambda t: t["code"]).alias("test_cases"),
    )


def is_repository(mode: Column) -> Column:
    return F.coalesce(mode.isin(*REPOSITORY_MODES), F.lit(False))


def _parses(source: str | None) -> bool:
    try:
        ast.parse(source or "")
        return True
    except (SyntaxError, ValueError):
        return False


def _kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for tests in batches:
        yield pd.Series([None if t is None else [x for x in t if x is not None and x.strip() and _parses(x)] for t in tests])


def compiling(tests: Column) -> Column:
    """The elements of an array that are not blank and compile, in order."""
    return F.pandas_udf(_kept, "array<string>")(tests)


def within_tokens(pairs: DataFrame, tests: str, limit: int, tokens) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): tests of fewer than `limit` tokens stay; a pair without any goes. `tokens` makes a count of a column.

    excluded has one row for each test that goes: id, test, tokens, reason.
    """
    kept = pairs.withColumn(tests, F.filter(tests, lambda t: tokens(t) < limit)).filter(F.size(tests) > 0)
    gone = pairs.select("id", F.explode(F.filter(tests, lambda t: tokens(t) >= limit)).alias("test"))
    return kept, gone.select("id", "test", tokens(F.col("test")).alias("tokens"), F.lit("completion_exceeds_limit").alias("reason"))


def pair_audit(pairs: DataFrame) -> DataFrame:
    """(id, type, reasons): the faults of a (golden, mutant) pair, in order; none if it is clean.

    Lines are compared by their place as far as both sides go. DEF_LINE and IMPORT_LINE stand once for each such line that
    differs; more than three lines are a LARGE_DIFF unless the type is compound; a null type is unknown. Null code is empty.
    """
    code = lambda c: F.coalesce(c, F.lit(""))
    lines = lambda c: F.split(F.regexp_replace(code(F.col(c)), r"\r?\n\z", ""), r"\r?\n")
    both = F.arrays_zip(lines("golden_code").alias("g"), lines("mutant_code").alias("m"))
    diff = F.filter(both, lambda x: x["g"].isNotNull() & x["m"].isNotNull() & (x["g"] != x["m"]))
    kind = F.coalesce("mutation_type", F.lit("unknown"))
    seen = pairs.withColumn("_diff", diff).withColumn("_parse", F.pandas_udf(_both_parse, "struct<golden:boolean,mutant:boolean>")("golden_code", "mutant_code"))
    d, marked = F.col("_diff"), lambda c: code(F.col(c)).rlike(r"\\[12]")
    one = lambda broken, name: F.when(broken, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    def of_line(x: Column) -> Column:
        text = F.trim(x["g"], F.lit(" \t\f"))
        return F.when(text.startswith("def "), "DEF_LINE").when(text.startswith("from ") | text.startswith("import "), "IMPORT_LINE")

    reasons = F.concat(
        one(code(F.col("golden_code")) == code(F.col("mutant_code")), "IDENTICAL"),
        one(~F.col("_parse.golden"), "GOLDEN_SYNTAX"),
        one(~F.col("_parse.mutant"), "MUTANT_SYNTAX"),
        one(F.coalesce(F.size("test_cases"), F.lit(0)) < 1, "NO_TESTS"),
        one(_or(F.col("entry_point")).isNull(), "NO_ENTRY"),
        F.array_compact(F.transform(d, of_line)),
        one((kind != "compound") & (F.size(d) > 3), "LARGE_DIFF"),
        one(marked("mutant_code") & ~marked("golden_code"), "REGEX_LEAK"),
    )
    return seen.select("id", kind.alias("type"), reasons.alias("reasons"))


def _both_parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in batches:
        yield pd.DataFrame({"golden": [_parses(x) for x in a], "mutant": [_parses(x) for x in b]})
