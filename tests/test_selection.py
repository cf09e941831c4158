import collections
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.operators import selection


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_position_counts_across_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(F.xxhash64("id").alias("h"), "id")
    got = selection.with_position(df, ["h"]).orderBy("h").select("pos").collect()
    assert [r["pos"] for r in got] == list(range(1000))


@pytest.mark.parametrize(("n", "k"), [(10, 3), (10, 1), (10, 10), (3, 10), (0, 5), (17, 6)])
def test_evenly_spaced(spark, n, k):
    got = sorted(r["pos"] for r in selection.evenly_spaced(spark.range(n), k, ["id"]).collect())
    want = list(range(n)) if n <= k else [n // 2] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    assert got == want


def greedy_repeat(rows, target, cap):
    groups = collections.defaultdict(list)
    for g, i in rows:
        groups[g].append(i)
    uses = {(g, i): 1 for g, i in rows}
    goal = max(len(rows), min(target, cap * len(rows)))
    size = {g: len(v) for g, v in groups.items()}
    while sum(size.values()) < goal:
        g = min((g for g in groups if size[g] < cap * len(groups[g])), key=lambda g: (size[g], g))
        i = min(groups[g], key=lambda i: (uses[g, i], i))
        uses[g, i] += 1
        size[g] += 1
    return uses


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), st.integers(0, 40), st.integers(1, 4))
def test_balanced_repeat_is_the_greedy_loop(spark, groups, target, cap):
    rows = [(g, i) for i, g in enumerate(groups)]
    out = selection.balanced_repeat(frame(spark, rows, "g string, i int"), "g", target, cap, ["i"])
    got = {(r["g"], r["i"]): r["n"] for r in out.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == greedy_repeat(rows, target, cap)


def test_balanced_repeat_fixture(spark):
    rows = [("a", i) for i in range(4)] + [("b", 4)] + [("c", 5), ("c", 6)]
    out = selection.balanced_repeat(frame(spark, rows, "g string, i int"), "g", 14, 3, ["i"])
    counts = collections.Counter(r["i"] for r in out.collect())
    assert sum(counts.values()) == 14 and max(counts.values()) <= 3
    one = selection.balanced_repeat(frame(spark, [("a", 1)], "g string, i int"), "g", 10, 3, ["i"])
    assert one.count() == 3


def test_repository_quota():
    assert selection.repository_quota(64, 40, 200, 0.1, 3) == (max(2, math.ceil(3 * 0.1 * 64 / (3 * 0.9 + 0.3))), 64 - max(2, math.ceil(3 * 0.1 * 64 / (3 * 0.9 + 0.3))))
    assert selection.repository_quota(10, 3, 2, 0.0, 3) == (3, 2)


def test_bounded_mix_covers_all_strata(spark):
    rows = [(i, "f", f"family{i % 4}", f"source{i % 3}") for i in range(200)] + [(200 + i, "r", f"project{i % 5}", "x") for i in range(40)]
    df = frame(spark, rows, "id int, side string, a string, b string")
    got = selection.bounded_mix(df, F.col("side") == "r", 64, (["a", "b"], ["a", "b"]), ["id"]).collect()
    again = selection.bounded_mix(df, F.col("side") == "r", 64, (["a", "b"], ["a", "b"]), ["id"]).collect()
    assert len(got) == 64 and sorted(got) == sorted(again)
    assert {r["a"] for r in got if r["side"] == "r"} == {f"project{i}" for i in range(5)}
    assert {r["a"] for r in got if r["side"] == "f"} == {f"family{i}" for i in range(4)}


def test_padding_places():
    assert selection.padding_places(5, 3) == [0, 2, 4]
    assert selection.padding_places(1, 2) == [0, 0]


def test_group_split_is_disjoint(spark):
    rows = [(f"g{i % 10}", i) for i in range(100)]
    out = selection.group_split(frame(spark, rows, "g string, i int"), "g", F.md5("g"))
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 80, "val": 10, "test": 10}


def test_positions_of_wide_rows(spark):
    """Half a million rows with a wide column over many partitions: no row is lost and places are 0 to n - 1 in order."""
    n = 500_000
    rows = spark.range(0, n, 1, 24).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 3).alias("wide"))
    placed = selection.with_position(rows, ["h"])
    got = placed.agg(F.count(F.lit(1)), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.count_if(F.length("wide") != 384)).first()
    assert tuple(got) == (n, n, 0, n - 1, 0)
    before = placed.select("pos", "h").join(placed.select((F.col("pos") + 1).alias("pos"), F.col("h").alias("last")), "pos")
    assert before.filter("last >= h").isEmpty()


def test_ranks_and_windows_within_a_few_groups(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("x"), (F.col("id") % 7).alias("v"))
    every = {}
    for r in rows.orderBy("x").collect():
        every.setdefault(r["g"], []).append((r["x"], r["v"]))
    ranked = {(r["g"], r["x"]): r["rank"] for r in selection.with_rank(rows, ["g"], ["x"]).collect()}
    assert ranked == {(g, x): i for g, own in every.items() for i, (x, _) in enumerate(own)}
    from pyspark.sql import Window

    w = Window.partitionBy("g", "part").orderBy("rank").rowsBetween(-9, 0)
    got = {(r["g"], r["x"]): r["s"] for r in selection.rolling(rows, ["g"], ["x"], 9, block=50).select("*", F.sum("v").over(w).alias("s")).filter("own").collect()}
    assert got == {(g, x): sum(v for _, v in own[max(0, i - 9) : i + 1]) for g, own in every.items() for i, (x, _) in enumerate(own)}
