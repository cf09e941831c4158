"""Run ledgers: lookups that must succeed, merges of sources, comparisons of runs, histories and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.lineage import checkpointed
from quarrylight.operators.selection import with_rank


def strict_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """df with the columns of lookup (unique by key). A key that lookup lacks fails the query where it is met."""
    there = [c for c in lookup.columns if c != key]
    joined = df.join(lookup.withColumn("_there", F.lit(True)), key, "left")
    message = F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")), F.lit(" in the lookup"))
    sure = lambda c: F.when(F.col("_there"), F.col(c)).otherwise(F.raise_error(message).cast(joined.schema[c].dataType))
    return joined.select(*(sure(c).alias(c) if c == key else F.col(c) for c in df.columns), *(sure(c).alias(c) for c in there))


def merge_sources(sources: list[DataFrame], key: str, volatile: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): the first source that has a key wins; sources conflict where they differ beyond volatile fields."""
    every = reduce(DataFrame.unionByName, [df.withColumn("_rank", F.lit(i)) for i, df in enumerate(sources)])
    stable = [c for c in sources[0].columns if c not in volatile and c != key]
    hashed = every.withColumn("_hash", F.sha2(F.to_json(F.struct(*stable), {"ignoreNullFields": "false"}), 256))
    rest = [c for c in sources[0].columns if c != key]
    found = hashed.groupBy(key).agg(F.min_by(F.struct(*rest), "_rank").alias("x"), F.count_distinct("_hash").alias("n"))
    return found.filter("n = 1").select(key, "x.*"), found.filter("n > 1").select(key, F.col("n").alias("versions"))


def behaviour(outcomes: DataFrame, key: str, buggy: Column, fixed: Column) -> DataFrame:
    """For each bug over its tests: whether the buggy and the fixed side pass all, and whether any test tells them apart."""
    return outcomes.groupBy(key).agg(F.bool_and(buggy).alias("buggy_passes_all"), F.bool_and(fixed).alias("fixed_passes_all"), F.bool_or(buggy != fixed).alias("behavior_differs"))


def requested(ids: DataFrame, known: DataFrame, key: str, place: str) -> DataFrame:
    """The requested ids, each once at its first place, and whether they are known."""
    first = ids.groupBy(key).agg(F.min(place).alias(place))
    return first.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left").select(key, place, F.coalesce("known", F.lit(False)).alias("known"))


def selected(ids: DataFrame, known: DataFrame, key: str, place: str) -> DataFrame:
    """The requested ids, each once, in the order of their first places. One that isn't known fails the query where it is met."""
    found = requested(ids, known, key, place)
    message = F.concat(F.lit(f"unknown {key} "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    sure = F.when(F.col("known"), F.col(place)).otherwise(F.raise_error(message).cast(found.schema[place].dataType))
    return found.select(key, sure.alias(place)).orderBy(place)


def audited_payloads(audit: DataFrame, payloads: DataFrame, key: str, count: str) -> DataFrame:
    """Audit rows whose recorded count is not that of their payload rows, either side missing included."""
    own = payloads.groupBy(key).agg(F.count(F.lit(1)).alias("payloads"))
    both = audit.select(key, F.col(count).alias("recorded")).join(own, key, "full_outer")
    return both.select(key, "recorded", "payloads").filter(~F.col("recorded").eqNullSafe(F.col("payloads")))


def best_and_worst(runs: DataFrame, run: str, metric: str) -> DataFrame:
    """The best run (its metric must be above 0) and the worst one, the first of equals; none with fewer than two runs."""
    best, worst = (F.min_by(F.struct(run, metric), F.struct(m, F.col(run))) for m in (-F.col(metric), F.col(metric)))
    out = runs.agg(best.alias("b"), worst.alias("w"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out.select(F.when(F.col("b")[metric] > 0, F.col("b")[run]).alias("best"), F.col("w")[run].alias("worst"), (F.col("b")[metric] - F.col("w")[metric]).alias("gap"))


def memory_stats(attempts: DataFrame, bug: Column, novel: Column) -> DataFrame:
    """Totals of a store: attempts, those added (bugs and novel ones), bugs, novel ones, and duplicates filtered."""
    one = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return attempts.agg(F.count(F.lit(1)).alias("attempts"), one(bug | novel).alias("added"), one(bug).alias("bugs"), one(novel).alias("novel"), one(~(bug | novel)).alias("duplicates"))


def iteration_counters(outcomes: DataFrame, iteration: str, winner: Column) -> DataFrame:
    """Per iteration: tests, and winners and losers so far, as the loop reports them. One small row for each iteration."""
    per = outcomes.groupBy(iteration).agg(F.count(F.lit(1)).alias("tests"), F.count_if(winner).alias("w"), F.count_if(~winner).alias("l"))
    so_far = Window.orderBy(iteration).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(iteration, "tests", F.sum("w").over(so_far).alias("winners"), F.sum("l").over(so_far).alias("losers"))


def best_of_history(trend: DataFrame, step: str, value: str, improved: str) -> DataFrame:
    """The improved step with the greatest value; the first of equals."""
    return trend.filter(improved).agg(F.min_by(F.struct(step, value), F.struct(-F.col(value), F.col(step))).alias("x")).select("x.*").filter(F.col(step).isNotNull())


def first_per_output(calls: DataFrame, group: str, output: str, place: str, call: str) -> DataFrame:
    """The first call of each distinct output of a group."""
    return calls.groupBy(group, output).agg(F.min_by(call, place).alias(call), F.min(place).alias(place))


def last_of_sides(rows: DataFrame, side: str, order: str, k: int) -> DataFrame:
    """The last 6 k rows of each side, with their place from the end."""
    n = F.row_number().over(Window.partitionBy(side).orderBy(F.desc(order)))
    return rows.withColumn("from_end", n).filter(F.col("from_end") <= 6 * k)


def pending_thresholds(trained: DataFrame, trend: DataFrame, count: str, step: int) -> DataFrame:
    """Multiples of `step` up to the greatest count that the trend does not have yet."""
    top = trained.agg(F.max(count).alias("t")).filter(F.col("t") >= step)
    due = top.select(F.explode(F.sequence(F.lit(step).cast("long"), F.col("t").cast("long"), F.lit(step).cast("long"))).alias("threshold"))
    return due.join(trend.select(F.col("threshold")), "threshold", "left_anti")


def for_prompt(memory: DataFrame, bug: Column, novel: Column, order: list, k: int) -> DataFrame:
    """Up to k remembered tests: those that found bugs first, then novel ones, in order."""
    kept = memory.withColumn("found_bug", F.coalesce(bug, F.lit(False))).filter(F.col("found_bug") | F.coalesce(novel, F.lit(False)))
    return kept.orderBy(F.desc("found_bug"), *order).limit(k)


def newest_valid(checkpoints: DataFrame, group: str, step: str, path: str, valid: Column) -> DataFrame:
    """The valid checkpoint with the greatest step of each group."""
    return checkpoints.filter(valid).groupBy(group).agg(F.max(step).alias(step), F.max_by(path, step).alias(path))


def value_products(functions: DataFrame, ident: str, parameters: str, values: list[str], limit: int) -> DataFrame:
    """(ident, nth, arguments): the first `limit` of the product of `values` for each parameter, in product order.

    The nth product is read off the digits of n, so no product is built beyond the limit.
    """
    base = len(values)
    total = F.least(F.lit(limit).cast("double"), F.pow(F.lit(float(base)), F.col(parameters))).cast("long")
    at = functions.filter(F.col(parameters) >= 1).select(ident, parameters, F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("nth"))
    choices = F.array(*map(F.lit, values))
    digit = lambda i: F.element_at(choices, (F.floor(F.col("nth") / F.pow(F.lit(float(base)), F.col(parameters) - i)) % base + 1).cast("int"))
    return at.select(ident, "nth", F.concat_ws(", ", F.transform(F.sequence(F.lit(1), F.col(parameters).cast("int")), digit)).alias("arguments"))


def distinct_fragments(fragments: DataFrame, text: str, order: str) -> DataFrame:
    """Fragments each once by the SHA-256 of their text, the first kept; blank ones go."""
    rest = [c for c in fragments.columns if c != order]
    own = fragments.filter(F.trim(text) != "").withColumn("sha256", F.sha2(text, 256))
    return own.groupBy("sha256").agg(F.min(order).alias(order), F.min_by(F.struct(*rest), order).alias("x")).select("sha256", order, "x.*")


def diverse(rows: DataFrame, kind: str, n: int, order: list) -> DataFrame:
    """n rows spread over the kinds: floor(n / kinds) of each, then a fill from the rest, both in order; adds phase and ordinal."""
    sizes = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("m"))
    kinds = sizes.count()
    if not kinds:
        return rows.withColumns({"phase": F.lit(0), "ordinal": F.lit(0).cast("long")})
    each = n // kinds
    ranked = checkpointed(with_rank(rows, [kind], order, "_nth"))
    first = ranked.filter(F.col("_nth") < each).withColumn("phase", F.lit(0))
    left = n - first.count()
    rest = ranked.filter(F.col("_nth") >= each).orderBy(*order).limit(max(0, left)).withColumn("phase", F.lit(1))
    chosen = first.unionByName(rest).drop("_nth")
    return chosen.withColumn("ordinal", (F.row_number().over(Window.orderBy("phase", kind, *order)) - 1).cast("long"))


def paired_examples(functions: DataFrame, template: str) -> DataFrame:
    """(id, prompt, chosen, rejected): the first test against the mutant as a comment; functions without tests drop out."""
    commented = F.concat(F.lit("# "), F.replace(F.col("mutant_code"), F.lit("\n"), F.lit("\n# ")))
    some = functions.filter(F.size("test_cases") > 0)
    return some.select("id", F.format_string(template, "golden_code").alias("prompt"), F.element_at("test_cases", 1).alias("chosen"), commented.alias("rejected"))


def routed(results: DataFrame, result: str) -> DataFrame:
    """Adds found_bug: the loop counts failures and errors alike."""
    return results.withColumn("found_bug", F.coalesce(F.lower(result).isin("fail", "error"), F.lit(False)))
