import math

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import code_text, stats
from quarrylight.operators import evaluation, similarity


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b"), [(0, 0), (1, 0), (5, 1), (40, 60), (900, 1100)])
def test_mcnemar(spark, a, b):
    d, tail = a + b, min(a, b)
    want = 1.0 if d == 0 else min(1.0, 2 * sum(math.comb(d, k) for k in range(tail + 1)) / 2**d)
    assert one(spark, stats.mcnemar_p(F.lit(a), F.lit(b))) == pytest.approx(want, rel=1e-6)


def test_wilson(spark):
    assert one(spark, stats.wilson(F.lit(0), F.lit(0), True)) == 0.0
    assert one(spark, stats.wilson(F.lit(67), F.lit(100), False)) == pytest.approx(0.573, abs=2e-3)


def test_transitions(spark):
    before = spark.createDataFrame([(i, i in (0, 1)) for i in range(4)], "id int, killed boolean")
    after = spark.createDataFrame([(i, i in (1, 2, 3)) for i in range(4)], "id int, killed boolean")
    r = evaluation.transitions(before, after, "id", "killed").first()
    assert (r["available"], r["improved"], r["regressed"], r["unchanged"]) == (True, 2, 1, 1)
    assert not evaluation.transitions(before, after.filter("id > 0"), "id", "killed").first()["available"]


def test_patience(spark):
    killed = [100, 100, 101, 101, 101, 101, 101, 101]
    rows = evaluation.patience(spark.createDataFrame(list(enumerate(killed)), "step int, killed int"), "step", "killed", 100, 1, 5).orderBy("step").collect()
    assert [r["improved"] for r in rows].index(True) == 2
    assert [r["stop"] for r in rows].index(True) == 7


def test_gates_fail_closed(spark):
    with pytest.raises(ValueError):
        evaluation.violations([])
    with pytest.raises(ValueError, match="dup"):
        evaluation.require_gates([("dup", spark.range(2), "id")])
    evaluation.require_gates([("none", spark.range(0), "id")])


def test_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, h string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "id int, h string")
    assert dict(map(tuple, evaluation.merge(base, new, "id", "h").collect())) == {1: "keep", 2: "skip", 3: "conflict", 4: "insert"}


def test_novelty_insert_is_the_greedy_loop(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kept = []
    for i in range(len(v)):
        if all(v[i] @ v[j] < 0.6 for j in kept):
            kept.append(i)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(len(v))], "id long, v array<double>")
    got = sorted(r["id"] for r in similarity.novelty_insert(df, "id", "v", 0.6).filter("accepted").collect())
    assert got == kept


def test_evidence(spark):
    zero = {"f2p_success": 0, "f2p_failure": 1, "p2p_success": 1, "p2p_failure": 0}
    good = {"f2p_success": 1, "f2p_failure": 0, "p2p_success": 1, "p2p_failure": 0}
    counts = "struct<f2p_success:int,f2p_failure:int,p2p_success:int,p2p_failure:int>"
    schema = f"e struct<fixed_returncode:int,buggy_returncode:int,fixed_pass_verified:boolean,buggy_fail_verified:boolean,base_counts:{counts},fixed_counts:{counts}>"
    rows = [((0, 1, None, None, None, None),), ((None, None, True, True, zero, good),), ((0, None, None, None, None, None),), ((None, None, True, True, zero, {**good, "p2p_failure": 1}),), ((None, None, True, True, {**zero, "f2p_failure": 0}, good),)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(code_text.evidence_verifies(F.col("e"))).collect()]
    assert got == [True, True, False, False, False]


def test_head_tail(spark):
    assert one(spark, code_text.head_tail(F.array(*map(F.lit, range(1, 8))), 5)) == [1, 2, 3, 6, 7]


def test_normalised_code(spark):
    assert one(spark, code_text.normalized_code(F.lit("\r\n a\r\nb \n"))) == "a\nb\n"


def test_versions(spark):
    for text, ok in (("v1", True), ("v3_final_candidate", True), ("v0", False), ("3", False), ("v1_", False)):
        assert one(spark, code_text.valid_version(F.lit(text))) is ok
