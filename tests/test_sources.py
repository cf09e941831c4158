import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarrylight import schemas
from quarrylight.sources import tables


def test_missing_file_gives_no_rows(spark, tmp_path):
    assert tables.read_json(spark, str(tmp_path / "none.json"), schemas.MBPP).count() == 0


def test_functions_of_three_sources(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps([{"task_id": "HumanEval/0", "prompt": "def f(x):\n", "canonical_solution": "    return x\n", "test": "assert f(1) == 1", "entry_point": "f"}]))
    with gzip.open(tmp_path / "m.jsonl.gz", "wt") as f:
        f.write(json.dumps({"task_id": "7", "text": "add", "code": "def add (a): return a", "test_list": ["assert add(1)"], "challenge_test_list": ["assert add(2)"]}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([{"project": "p", "bug_id": "1", "buggy_code": "b", "fixed_code": "f", "test_cases": "assert 1", "category": "c", "entry_point": "f"}]))
    parts = [
        tables.humaneval_functions(tables.read_json(spark, str(tmp_path / "h.json"), schemas.HUMANEVAL)),
        tables.mbpp_functions(tables.read_json(spark, str(tmp_path / "m.jsonl.gz"), schemas.MBPP, multi_line=False)),
        tables.bug_functions(tables.read_json(spark, str(tmp_path / "b.json"), schemas.BUGS)),
    ]
    rows = {r["id"]: r for r in tables.unified(parts).collect()}
    assert rows["humaneval_HumanEval_0"]["test_cases"] == ["assert f(1) == 1"]
    assert rows["mbpp_7"]["entry_point"] == "add" and rows["mbpp_7"]["test_cases"] == ["assert add(1)", "assert add(2)"]
    assert rows["p_1"]["code"] == "f" and rows["p_1"]["test_cases"] == ["assert 1"]


def test_assignments(spark, tmp_path):
    (tmp_path / "bug.info").write_text('python_version="3.7"\nbuggy_commit_id="abc"\ntest_file="a;b"\n')
    assert tables.assignments(spark, str(tmp_path)).first()["values"] == {"python_version": "3.7", "buggy_commit_id": "abc", "test_file": "a;b"}


def test_patches(spark):
    patch = "diff --git a/x b/x\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-old\n+new\n same\n"
    r = spark.createDataFrame([(patch,), ("nothing",)], "p string").select(tables.patch_code(F.col("p")).alias("c"), tables.patched_paths(F.col("p")).alias("f")).collect()
    assert r[0]["c"] == "new\nsame" and r[0]["f"] == ["x.py"] and r[1]["c"] == "nothing"


def test_split_order_is_kept(spark):
    splits = spark.createDataFrame([(["b", "a"], ["c"], [])], schemas.SPLITS)
    records = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r["id"] for r in tables.split_records(records, splits, "train").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no id b in the lookup"):
        tables.split_records(records.filter("id <> 'b'"), splits, "train").collect()


def test_write_once(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    tables.write_once(df, path)
    tables.write_once(df, path)
    with pytest.raises(ValueError):
        tables.write_once(spark.range(4), path)


def test_append_missing(spark):
    old, new = spark.createDataFrame([(1, "a")], "id int, v string"), spark.createDataFrame([(1, "x"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, tables.append_missing(old, new).collect())) == [(1, "a"), (2, "b")]


def test_prepared_and_library_functions(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": "a", "code": "x = 1"}, {"source": "s", "test_cases": ["t"], "complexity_score": 2}]')
    got = sorted((tuple(r) for r in tables.golden_functions(spark, str(tmp_path / "g.json")).collect()), reverse=True)
    assert got == [("a", "golden", "x = 1", "", "", "", [], "general", 5), ("", "s", "", "", "", "", ["t"], "general", 2)]
    assert tables.golden_functions(spark, str(tmp_path / "none.json")).count() == 0
    rows = spark.createDataFrame([("1", "lib.part.merge", None, "merge(a)", "doc", "data", 7)], "id string, name string, wrapper_code string, signature string, docstring string, category string, complexity_score int")
    assert tuple(tables.system_functions(rows).first()) == ("1", "system", "", "merge(a)", "merge", "doc", [], "data", 7)


def test_fingerprints_and_defaults(spark):
    from quarrylight.functions import outcomes

    df = spark.createDataFrame([("c:", "s", None, False), ("c:", "s", "c:old\n", False), ("c:", "s", "c:old", True)], "c string, s string, f string, run boolean")
    print_ = lambda d: [r[0] for r in d.select(outcomes.dataset_fingerprint(*map(F.col, ("c", "s", "f", "run")))).collect()]
    assert print_(df) == ["c:sft_scope=s", "c:old", "c:sft_scope=s"]
    with pytest.raises(Exception, match="of another corpus"):
        print_(df.withColumn("f", F.lit("d:old")))
    maps = spark.createDataFrame([({"lr_scheduler_type": "linear", "x": "1"},), (None,)], "m map<string,string>")
    assert [r[0] for r in maps.select(outcomes.with_run_defaults(F.col("m"))).collect()] == [{**outcomes.RUN_DEFAULTS, "lr_scheduler_type": "linear", "x": "1"}, outcomes.RUN_DEFAULTS]
