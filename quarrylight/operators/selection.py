"""Deterministic panels, subsets, repetition and ordering. Order is data: every operator takes a total order."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.lineage import checkpointed, fresh


#: Groups up to which their first places are broadcast (a key and a number each).
BROADCAST_GROUPS = 100_000


def with_position(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Add the 0-based place in a total order, without one task that sees all rows.

    A range exchange sorts once; the rows are checkpointed with their partition and their place in it, so that the counts and
    the rows come from the same partitions. One small row for each partition gives its start.
    """
    m, p, s = fresh(df, "_m"), fresh(df, "_p"), fresh(df, "_s")
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(m, F.monotonically_increasing_id()))
    part, inside = F.shiftright(m, 33), F.col(m).bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias(p)).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(p, F.coalesce(F.sum("n").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(s))
    return placed.withColumn(p, part).join(F.broadcast(starts), p).withColumn(name, F.col(s) + inside).drop(m, p, s)


def with_rank(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Add the 0-based place within the group of `keys`, also where a few groups hold all rows: places of the whole order, less
    the group's first one."""
    pos, first = fresh(df, "_pos"), fresh(df, "_first")
    placed = checkpointed(with_position(df, [*keys, *order], pos))
    firsts = placed.groupBy(*keys).agg(F.min(pos).alias(first))
    named = firsts.select(*(F.col(k).alias(f"{first}{i}") for i, k in enumerate(keys)), first)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{first}{i}")) for i, k in enumerate(keys)])
    side = F.broadcast(named) if firsts.count() <= BROADCAST_GROUPS else named
    return placed.join(side, same).withColumn(name, F.col(pos) - F.col(first)).drop(pos, first, *(f"{first}{i}" for i in range(len(keys))))


def rolling(df: DataFrame, keys: list[str], order: list, rows: int, block: int = 4096) -> DataFrame:
    """Rows with `part`, blocks of their group, so that a window over (keys, part) by `rank` sees the `rows` before each row.

    A block also holds the last rows of the one before, marked by own = false: filter them out after the window.
    """
    ranked = with_rank(df, keys, order)
    at = F.floor(F.col("rank") / block)
    parts = F.when(F.col("rank") % block >= block - rows, F.array(at, at + 1)).otherwise(F.array(at))
    return ranked.withColumn("part", F.explode(parts)).withColumn("own", F.col("part") == at)


def evenly_spaced(df: DataFrame, k: int, order: list) -> DataFrame:
    """k rows at evenly spaced places (half to even), with their place; all rows if there are no more than k; the middle if k is 1."""
    n = df.count()
    if n <= k:
        return with_position(df, order)
    chosen = [n // 2] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    return with_position(df, order).filter(F.col("pos").isin(chosen))


def stratified(df: DataFrame, keys: list[str], k: int, order: list) -> DataFrame:
    """k rows over strata: the middle row of evenly spaced strata, then an evenly spaced fill from the rest.

    Adds phase (0 pick, 1 fill) and place (the order within the phase).
    """
    named = df.withColumns({f"_k{i}": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown")) for i, c in enumerate(keys)})
    by = [f"_k{i}" for i in range(len(keys))]
    groups = [tuple(r[b] for b in by) + (r["n"],) for r in named.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(*by).collect()]
    total = sum(g[-1] for g in groups)
    if total <= k:
        return with_position(df, order, "place").withColumn("phase", F.lit(0))
    m = min(k, len(groups))
    at = range(len(groups)) if m >= len(groups) else [len(groups) // 2] if m == 1 else [round(i * (len(groups) - 1) / (m - 1)) for i in range(m)]
    picks = df.sparkSession.createDataFrame([(i, *groups[j][:-1], groups[j][-1] // 2) for i, j in enumerate(at)], ", ".join(["place long", *(f"{b} string" for b in by), "middle long"]))
    ranked = with_rank(named, by, order, "_r")
    initial = ranked.join(F.broadcast(picks), by).filter("_r = middle").drop("middle", "_r", *by).withColumn("phase", F.lit(0))
    if k <= m:
        return initial
    rest = ranked.join(F.broadcast(picks.select(*by, F.col("middle").alias("_r"))), [*by, "_r"], "left_anti").drop("_r", *by)
    fill = evenly_spaced(rest, k - m, order).withColumnRenamed("pos", "place").withColumn("phase", F.lit(1))
    return initial.unionByName(fill)


def repository_quota(limit: int, repository: int, synthetic: int, fraction: float, repeats: int) -> tuple[int, int]:
    """How many rows of each side a bounded mixed sample takes."""
    target = 0 if fraction == 0 else math.ceil(3 * fraction * limit / (repeats * (1 - fraction) + 3 * fraction))
    repo = min(repository, max(2 if limit >= 32 else 1, target), limit - 1)
    synth = min(synthetic, limit - repo)
    return min(repository, limit - synth), synth


def bounded_mix(df: DataFrame, is_repository: Column, limit: int, strata: tuple[list[str], list[str]], order: list, fraction: float = 0.1, repeats: int = 3) -> DataFrame:
    """At most `limit` rows of two sides, each stratified, in source order."""
    sides = df.withColumn("_repo", is_repository)
    n = {r["_repo"]: r["count"] for r in sides.groupBy("_repo").count().collect()}
    total, repo = sum(n.values()), n.get(True, 0)
    if limit <= 0 or limit >= total:
        return df
    if limit < 2 or not repo or repo == total:
        return with_position(df, order).filter(F.col("pos") < limit).drop("pos")
    r, s = repository_quota(limit, repo, total - repo, fraction, repeats)
    parts = stratified(sides.filter("NOT _repo"), strata[0], s, order), stratified(sides.filter("_repo"), strata[1], r, order)
    return parts[0].unionByName(parts[1]).drop("_repo", "phase", "place")


def balanced_repeat(df: DataFrame, group: str, target: int, cap: int, order: list) -> DataFrame:
    """Repeat rows of small groups until there are `target` in all, none more than `cap` times; adds copy (0: the original).

    Copies go to the smallest group and its least repeated row. In closed form, slot j of a group of m rows has the size
    m + j before it; slots in order of (size, group) are the greedy order, and slot j copies row j modulo m.
    """
    named = df.withColumn("_g", F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.lit("unknown")))
    sizes = checkpointed(named.groupBy("_g").agg(F.count(F.lit(1)).alias("m")))
    n = sizes.agg(F.sum("m")).first()[0] or 0
    wanted = max(n, min(target, n * cap)) - n
    originals = named.withColumn("copy", F.lit(0))
    if wanted <= 0 or cap < 2:
        return originals.drop("_g")
    below = lambda level: F.greatest(F.lit(0), F.least(F.col("m") * (cap - 1), F.lit(level) - F.col("m")))
    low, high = 0, n * cap + 1  # the greatest level with fewer than `wanted` slots below it
    while high - low > 1:
        middle = (low + high) // 2
        if sizes.agg(F.sum(below(middle))).first()[0] < wanted:
            low = middle
        else:
            high = middle
    before = sizes.agg(F.sum(below(low))).first()[0]
    at_level = sizes.filter((F.col("m") <= low) & (F.col("m") * cap > low)).orderBy("_g").limit(wanted - before).select("_g", F.lit(1).alias("edge"))
    taken = sizes.join(at_level, "_g", "left").select("_g", "m", (below(low) + F.coalesce("edge", F.lit(0))).alias("slots")).filter("slots > 0")
    ranked = with_rank(named, ["_g"], order, "_r").join(F.broadcast(taken) if taken.count() <= BROADCAST_GROUPS else taken, "_g")
    copies = F.floor((F.col("slots") + F.col("m") - 1 - F.col("_r")) / F.col("m")).cast("int")
    repeated = ranked.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("_r", "copies", "m", "slots")
    return originals.unionByName(repeated).drop("_g")


def uniform_repeat(df: DataFrame, wanted: int, cap: int) -> DataFrame:
    n = max(1, df.count())
    times = min(cap, max(1, math.ceil(wanted / n)))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def padding_places(n: int, p: int) -> list[int]:
    """Deterministic places that fill a last batch of p from n rows."""
    return [min(n - 1, int((i + 0.5) * n / p)) for i in range(p)]


def round_robin(df: DataFrame, group: Column, order: list) -> DataFrame:
    """Adds depth, the place in the group; ordering by (depth, group) interleaves the groups."""
    return with_rank(df.withColumn("grp", F.lower(group)), ["grp"], order, "depth").withColumn("depth", (F.col("depth") + 1).cast("int"))


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; Spark limits each partition before the shuffle, so a hot key is not gathered."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def quota_top(df: DataFrame, group: str, quota: int, limit: int, order: list) -> DataFrame:
    """At most `quota` rows of each group in order, up to `limit`, filled from the rest in order; adds phase."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    chosen = ranked.filter(F.col("_n") <= quota).orderBy(*order).limit(limit).withColumn("phase", F.lit(0))
    k = chosen.count()
    if k >= limit:
        return chosen.drop("_n")
    rest = ranked.filter(F.col("_n") > quota).orderBy(*order).limit(limit - k).withColumn("phase", F.lit(1))
    return chosen.unionByName(rest).drop("_n")


def fraction_split(df: DataFrame, key: list, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Split rows by their place in a seeded order."""
    n = df.count()
    a, b = int(n * train), int(n * val)
    pos = F.col("pos")
    return with_position(df, key).withColumn("split", F.when(pos < a, "train").when(pos < a + b, "val").otherwise("test")).drop("pos")


def group_split(df: DataFrame, group: str, order: Column, limit: int = 1_000_000) -> DataFrame:
    """Whole groups to train, val and test, each in turn to the split that lacks most; ties to the smaller one, then in that order.

    The fold runs on the driver over one row for each group, at most `limit` of them; beyond that it raises, and bucket_split
    is the way. The groups' splits are broadcast, which `limit` bounds too.
    """
    found = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(order, group).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} groups; use bucket_split")
    total = sum(r["n"] for r in found)
    want = {"train": int(total * 0.8), "val": int(total * 0.1)}
    want["test"] = total - sum(want.values())
    have, rows = dict.fromkeys(want, 0), []
    for r in found:
        to = max(want, key=lambda s: (want[s] - have[s], -have[s]))
        have[to] += r["n"]
        rows.append((r[group], to))
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, df.select(group).schema.add("split", "string"))), group)
