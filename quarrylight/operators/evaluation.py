"""Metrics, comparisons, labels and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.stats import mcnemar_p, rate, wilson

SUMS = ("requested", "parsed", "generation_invalid", "execution_invalid", "invalid", "valid", "killing")


def kill_rates(facts: DataFrame, group: str, killed: Column) -> DataFrame:
    """Killed of all per group with the Wilson interval."""
    n, k = F.count(F.lit(1)), F.sum(killed.cast("int"))
    return facts.groupBy(group).agg(n.alias("n"), k.alias("killed")).select(group, "n", "killed", rate(F.col("killed"), F.col("n")).alias("kill_rate"), wilson(F.col("killed"), F.col("n"), False).alias("low"), wilson(F.col("killed"), F.col("n"), True).alias("high"))


def accounting(facts: DataFrame, group: str) -> DataFrame:
    """The eight sums and four rates of candidate accounting for each group."""
    sums = facts.groupBy(group).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("killed").cast("int")).alias("killed_records"), *(F.sum(c).alias(c) for c in SUMS))
    c = F.col
    return sums.select("*", rate(c("killed_records"), c("records")).alias("kill_rate"), rate(c("killing"), c("valid")).alias("candidate_rate"), rate(c("killing"), c("requested")).alias("end_to_end_rate"), rate(c("parsed"), c("requested")).alias("parse_rate"))


def first_kill(outcomes: DataFrame, key: str, killed: Column, order: list) -> DataFrame:
    """Tests run until the first kill, and whether there was one; later tests do not count."""
    ranked = outcomes.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.groupBy(key).agg(F.coalesce(F.min(F.when(killed, F.col("pos"))), F.count(F.lit(1))).cast("long").alias("tests_run"), F.max(killed.cast("int")).alias("killed"))


def transitions(before: DataFrame, after: DataFrame, key: str, flag: str) -> DataFrame:
    """Improved, regressed, unchanged, and the exact p-value, for two runs over one set of keys; unavailable otherwise."""
    a, b = before.select(key, F.col(flag).alias("a")), after.select(key, F.col(flag).alias("b"))
    both = a.join(b, key, "full_outer")
    out = both.agg(
        F.coalesce(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()), F.lit(False)).alias("available"),
        F.count_if(~F.col("a") & F.col("b")).alias("improved"),
        F.count_if(F.col("a") & ~F.col("b")).alias("regressed"),
        F.count_if(F.col("a") == F.col("b")).alias("unchanged"),
    )
    return out.withColumn("p_value", F.round(mcnemar_p(F.col("improved"), F.col("regressed")), 9))


def patience(trend: DataFrame, step: str, value: str, baseline: float, min_gain: float, limit: int) -> DataFrame:
    """Whether each step beats the best so far by `min_gain`, the run of steps that did not, and whether to stop.

    The trend is one row for each checkpoint, so it is one small partition.
    """
    best = F.greatest(F.lit(float(baseline)), F.coalesce(F.max(value).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)), F.lit(float(baseline))))
    marked = trend.withColumn("improved", F.col(value) - best >= min_gain)
    island = F.sum(F.col("improved").cast("int")).over(Window.orderBy(step))
    marked = marked.withColumn("island", F.coalesce(island, F.lit(0)))
    run = F.sum((~F.col("improved")).cast("int")).over(Window.partitionBy("island").orderBy(step))
    return marked.withColumn("run", run.cast("long")).withColumn("stop", F.col("run") >= limit).drop("island")


def feedback(valid: Column, found: Column, similarity: Column, threshold: float) -> tuple[Column, Column]:
    """(label, reason): invalid tests lose, bugs win, novel tests win, the rest lose."""
    label = F.when(~valid, "loser").when(found, "winner").when(similarity < threshold, "winner").otherwise("loser")
    reason = F.when(~valid, "Invalid").when(found, "Bug found").when(similarity < threshold, "Novel").otherwise(F.format_string("Redundant (similarity: %.3f)", similarity))
    return label, reason


def preference_pairs(winners: DataFrame, losers: DataFrame, key: str, order: str, first: int = 2, each: int = 3) -> DataFrame:
    """The first winners of each key with the first losers in order; both sides are cut before the join."""
    top = lambda df, n: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n).drop("_n", order)
    return top(winners, first).join(top(losers, each), key)


def differential(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """PASS, FAIL or ERROR for two runs' (key, ok, output)."""
    a, b = left.select(key, F.col("ok").alias("ok_a"), F.col("output").alias("out_a")), right.select(key, F.col("ok").alias("ok_b"), F.col("output").alias("out_b"))
    both = a.join(b, key, "full_outer")
    ok_a, ok_b = F.coalesce("ok_a", F.lit(False)), F.coalesce("ok_b", F.lit(False))
    return both.select(key, F.when(~ok_a & ~ok_b, "ERROR").when(ok_a != ok_b, "FAIL").when(F.col("out_a").eqNullSafe(F.col("out_b")), "PASS").otherwise("FAIL").alias("outcome"))


def violations(gates: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(gate, id) of all violations of named gates; no gate at all is a violation too."""
    if not gates:
        raise ValueError("no gate is no approval")
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("gate"), F.col(key).cast("string").alias("id")) for name, df, key in gates])


def require_gates(gates: list[tuple[str, DataFrame, str]]) -> None:
    """Raise if any gate has a violation; the driver gets one count for each gate."""
    failed = {r["gate"]: r["count"] for r in violations(gates).groupBy("gate").count().collect()}
    if failed:
        raise ValueError(f"gates failed: {failed}")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n")).filter("n > 1")


def merge(base: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, action) of a merge: insert, skip (equal), conflict, or keep."""
    a, b = base.select(key, F.col(payload).alias("a")), new.select(key, F.col(payload).alias("b"), F.lit(True).alias("there"))
    both = a.withColumn("here", F.lit(True)).join(b, key, "full_outer")
    return both.select(key, F.when(F.col("here").isNull(), "insert").when(F.col("there").isNull(), "keep").when(F.col("a").eqNullSafe(F.col("b")), "skip").otherwise("conflict").alias("action"))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(key, "x.*")


def semantic_repair(df: DataFrame, supervision: str, group: str, split: str, ident: str) -> DataFrame:
    """One row for each supervision key, the strictest split first, then the smallest id; a whole group moves to its strictest split."""
    order = F.when(F.col(split) == "test", 0).when(F.col(split) == "val", 1).otherwise(2)
    kept = df.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(supervision).orderBy("_o", ident))).filter("_n = 1")
    strict = kept.groupBy(group).agg(F.min("_o").alias("_s"))
    return kept.join(strict, group).withColumn("new_split", F.element_at(F.array(F.lit("test"), F.lit("val"), F.lit("train")), F.col("_s") + 1)).drop("_o", "_n", "_s")
