"""Mutation pairs until a target: first-order mutants of functions in their order, then mutants of mutants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.pycode import mutants_column
from quarrylight.operators.lineage import checkpointed, fresh
from quarrylight.operators.selection import with_position
from quarrylight.operators.swaps import seeded_order

#: Mutants that a function is expected to have at least, when the first round is sized.
EXPECTED = 4
#: First-order mutants of a function that the second pass starts from.
STARTS = 5


def _numbered(pairs: DataFrame, order: list, start: int, target: int) -> DataFrame:
    """pairs with seq, which goes on from start in the order given and ends at target."""
    return with_position(pairs, order, "seq").withColumn("seq", F.col("seq") + 1 + start).filter(F.col("seq") <= target)


def generate_pairs(functions: DataFrame, ident: str, order: str, code: str, target: int, seed: int = 42) -> DataFrame:
    """(seq, id, ident, golden_code, mutant_code, mutation_type, description): `target` pairs, or all there are.

    Functions give their first-order mutants one after another by `order`, each function's in a seeded shuffle, until the
    target; ids are `<ident>_mut_<seq>`. If that is not enough, functions with two mutants or more give second-order ones in a
    seeded order: each of a function's first five mutants is mutated again, and a seeded one of the results is a pair of type
    compound, `<ident>_cmp_<seq>`. seq runs from 1 without gaps at any number of partitions.

    Functions are mutated in rounds of growing size, each checkpointed, and no more of them than the target needs.
    """
    key, nth, m = "_order", "_nth", "_m"
    own = functions.select(F.col(ident).alias(ident), F.col(order).alias(fresh(functions, key)), F.col(code).alias("golden_code"))
    key = own.columns[1]
    placed = checkpointed(with_position(own, [key, ident], "_at"))
    rounds: list[DataFrame] = []
    low, size, found, n = 0, max(1, target // EXPECTED), 0, placed.count()
    while low < n and found < target:
        part = placed.filter(F.col("_at").between(low, low + size - 1)).repartition("_at")
        rounds.append(checkpointed(part.select("*", F.posexplode(mutants_column("golden_code")).alias(nth, m))))
        found += rounds[-1].count()
        low, size = low + size, 2 * size
    if not rounds:
        return _shaped(placed.limit(0).select("*", F.lit(0).cast("long").alias("seq"), *(F.lit("").alias(c) for c in ("kind", "mutant_code", "mutation_type", "description"))), ident)
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    first = _numbered(every.withColumn("_shuffle", seeded_order(ident, F.col(nth), seed)), ["_at", "_shuffle"], 0, target)
    first = first.select(ident, "golden_code", "seq", F.lit("mut").alias("kind"), f"{m}.mutant_code", f"{m}.mutation_type", f"{m}.description")
    if found >= target:
        return _shaped(first, ident)
    several = every.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("_at")
    starts = every.filter(F.col(nth) < STARTS).join(several, "_at", "left_semi").repartition("_at", nth)
    again = starts.select("*", mutants_column(f"{m}.mutant_code").alias("_again")).filter("size(_again) > 0")
    drawn = F.conv(F.substring(seeded_order(ident, F.concat(F.lit("second:"), F.col(nth)), seed), 1, 8), 16, 10).cast("long")
    chosen = again.withColumn("_c", F.element_at("_again", (drawn % F.size("_again") + 1).cast("int"))).drop("_again")
    second = _numbered(chosen.withColumn("_shuffle", seeded_order(ident, F.lit("function"), seed)), ["_shuffle", "_at", nth], found, target)
    compound = second.select(ident, "golden_code", "seq", F.lit("cmp").alias("kind"), "_c.mutant_code", F.lit("compound").alias("mutation_type"), F.concat(f"{m}.description", F.lit(" AND "), "_c.description").alias("description"))
    return _shaped(first.unionByName(compound), ident)


def _shaped(pairs: DataFrame, ident: str) -> DataFrame:
    name = F.concat(F.col(ident).cast("string"), F.lit("_"), "kind", F.lit("_"), F.format_string("%05d", "seq"))
    return pairs.select("seq", name.alias("id"), ident, "golden_code", "mutant_code", "mutation_type", "description")
