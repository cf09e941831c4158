"""Readers and writers of record files; every reader has a fixed schema, so no scan infers one."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.functions.code_text import category, complexity
from quarrylight.operators.ledger import strict_lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost far more to work on than to read, dealt out to all cores: a small file is read by few tasks."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A JSON array or JSONL file (compressed by extension); a missing path gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_list(c) -> F.Column:
    """A string that holds a JSON array, as an array; anything else gives an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def humaneval_functions(raw: DataFrame, computed: bool = False) -> DataFrame:
    code = F.concat("prompt", "canonical_solution")
    tests = F.when(F.coalesce("test", F.lit("")) != "", F.array("test")).otherwise(F.array().cast("array<string>"))
    return raw.select(
        F.concat(F.lit("humaneval_"), F.replace("task_id", F.lit("/"), F.lit("_"))).alias("id"),
        F.lit("humaneval").alias("source"),
        code.alias("code"),
        F.col("prompt").alias("docstring"),
        "entry_point",
        tests.alias("test_cases"),
        (category(code, F.col("prompt")) if computed else F.lit("coding_challenge")).alias("category"),
        (complexity(code) if computed else F.lit(6)).alias("complexity_score"),
    )


def mbpp_functions(raw: DataFrame, computed: bool = False) -> DataFrame:
    none = F.array().cast("array<string>")
    tests = F.coalesce("test_list", none) if computed else F.concat(F.coalesce("test_list", none), F.coalesce("challenge_test_list", none))
    return raw.select(
        F.concat(F.lit("mbpp_"), "task_id").alias("id"),
        F.lit("mbpp").alias("source"),
        "code",
        F.col("text").alias("docstring"),
        F.regexp_extract("code", r"def\s+(\w+)\s*\(", 1).alias("entry_point"),
        tests.alias("test_cases"),
        (category(F.col("code"), F.col("text")) if computed else F.lit("coding_challenge")).alias("category"),
        (complexity(F.col("code")) if computed else F.lit(5)).alias("complexity_score"),
    )


def bug_functions(raw: DataFrame, use_buggy: bool = False) -> DataFrame:
    """Bug metadata as functions; test_cases is a JSON array or one test as a plain string."""
    one = F.col("test_cases")
    tests = F.when(one.isNull() | (one == ""), F.array().cast("array<string>")).when(one.startswith("["), json_list(one)).otherwise(F.array(one))
    return raw.select(
        F.concat_ws("_", "project", "bug_id").alias("id"),
        F.lit("bugs").alias("source"),
        (F.col("buggy_code") if use_buggy else F.col("fixed_code")).alias("code"),
        F.col("description").alias("docstring"),
        "entry_point",
        tests.alias("test_cases"),
        "category",
        F.lit(7).alias("complexity_score"),
    )


def unified(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def append_missing(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def golden_functions(spark: SparkSession, path: str) -> DataFrame:
    """Functions that were prepared before, with defaults for what they lack; a missing file gives no rows."""
    raw = read_json(spark, path, schemas.FUNCTIONS)
    text = lambda c, d="": F.coalesce(c, F.lit(d)).alias(c)
    tests = F.coalesce("test_cases", F.array().cast("array<string>")).alias("test_cases")
    return raw.select(text("id"), text("source", "golden"), text("code"), text("signature"), text("entry_point"), text("docstring"), tests, text("category", "general"), F.coalesce("complexity_score", F.lit(5)).alias("complexity_score"))


def system_functions(rows: DataFrame) -> DataFrame:
    """Library functions (id, name, wrapper_code, signature, docstring, category, complexity_score) as functions without tests;
    the entry point is the last part of the dotted name."""
    code = F.coalesce("wrapper_code", F.lit("")).alias("code")
    return rows.select("id", F.lit("system").alias("source"), code, "signature", F.element_at(F.split("name", r"\."), -1).alias("entry_point"), "docstring", F.array().cast("array<string>").alias("test_cases"), "category", "complexity_score")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of `key=value` files below a path; quotes around a value are dropped."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.contains("="))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^=]*=", "")), r"^[\"']|[\"']$", "").alias("value"))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.map_from_entries(F.transform(lines, pair)).alias("values"))


def patch_code(patch) -> F.Column:
    """Added and context lines of a unified diff, or its first 500 characters if it has none."""
    lines = F.filter(F.split(patch, "\n"), lambda x: (x.startswith("+") & ~x.startswith("+++")) | x.startswith(" "))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^.", "")), "\n")).otherwise(F.substring(patch, 1, 500))


def patched_paths(patch) -> F.Column:
    """Distinct paths of the new sides of a unified diff, sorted."""
    lines = F.filter(F.split(patch, "\n"), lambda x: x.startswith("+++ b/"))
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\+\+\+ b/", "")))))


def split_rows(splits: DataFrame) -> DataFrame:
    """(split, pos, record_id) of a table with one array column for each split."""
    parts = [splits.select(F.lit(name).alias("split"), F.posexplode(name).alias("pos", "record_id")) for name in splits.columns]
    return reduce(DataFrame.unionByName, parts)


def split_records(records: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """The records of a split in its own order. An id without a record fails the query where it is met."""
    ids = split_rows(splits).filter(F.col("split") == split).select("pos", F.col("record_id").alias("id"))
    return strict_lookup(ids, records, "id").orderBy("pos").select(*records.columns, "pos")


def write_once(df: DataFrame, path: str) -> None:
    """Write a table; the same rows at the path are left alone, other rows raise."""
    spark = df.sparkSession
    try:
        there = spark.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return
    if not df.exceptAll(there).isEmpty() or not there.exceptAll(df).isEmpty():
        raise ValueError(f"{path} holds other rows")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, schemas.RECORDS)
