"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by random rotations, shifted, and put in the order of a Hilbert curve; several
such orders are range-partitioned by Spark and cut into blocks of ranks. A query looks at a window of ranks around its own
in every order; candidates are reranked by the exact inner product and merged. Equal vectors are one class on the curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import cut_lineage, read_table

NEIGHBOURS = 20


@dataclass(frozen=True)
class CurveIndex:
    """A query sees a window of ranks on each side of its own, in each of `curves` orders. The window is fitted: on `probes`
    queries, whose true neighbours an exact pass over all rows finds, it is the least that holds the share `target` of them
    in some order. Nothing else of the index depends on the data's size."""

    curves: int = 8
    target: float = 0.95
    probes: int = 128
    least_window: int = 256
    dimensions: int = 16
    block: int = 16384
    queries_at_once: int = 4096
    fit_rows: int = 4096
    seed: int = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows), as int64 that sort like the curve; dims * bits <= 64."""
    axes = cells.T.astype(np.uint64)
    n, zero = len(axes), np.uint64(0)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - np.uint64(1)
        for i in range(n):
            flip = (axes[i] & q) != 0
            swap = np.where(flip, zero, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(flip, low, swap)
            axes[i] ^= swap
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        turn ^= np.where((axes[n - 1] & q) != 0, q - np.uint64(1), zero)
    axes ^= turn
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | axes[i] >> np.uint64(level) & np.uint64(1)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


@dataclass(frozen=True)
class Curve:
    """One order: rotate, scale to the fitted spread, shift, quantise, and walk the Hilbert curve."""

    rotation: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    shift: np.ndarray
    bits: int

    def keys(self, points: np.ndarray) -> np.ndarray:
        unit = ((points @ self.rotation - self.middle) / self.spread + 1) * 0.375 + self.shift
        return hilbert_keys((np.clip(unit, 0, np.nextafter(1, 0)) * (1 << self.bits)).astype(np.uint64), self.bits)


def fit_curves(sample: np.ndarray, index: CurveIndex) -> list[Curve]:
    """Curves for points like those of the sample (rows), each on random directions that lean to where the sample spreads most."""
    rng, width = np.random.default_rng(index.seed), sample.shape[1]
    d = min(index.dimensions, width)
    centred = sample - sample.mean(0)
    spread, axes = np.linalg.eigh(centred.T @ centred / max(1, len(sample)))
    lean = axes * np.sqrt(np.maximum(spread, 1e-12 * max(spread.max(), 1e-300)))
    out = []
    for _ in range(index.curves):
        rotation = np.linalg.qr(lean @ rng.normal(size=(width, d)))[0][:, :d]
        seen = sample @ rotation
        out.append(Curve(rotation, seen.mean(0), np.maximum(3.2 * seen.std(0), 1e-12), rng.random(d) * 0.25, min(16, 64 // d)))
    return out


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1) if rows else np.zeros((0, 1))


def vector_classes(vectors: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """(classes, queries): classes have cid (smallest vec_id), ids (the k + 1 smallest), embedding, asked; queries vec_id, cid."""
    usable = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)")
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    usable = cut_lineage(usable)
    sizes = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    usable = usable.filter(F.size("embedding") == (sizes[0]["d"] if sizes else 0))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = usable.filter(F.col("vec_id") % every == 0)
    asked = asking.select("embedding").distinct().withColumn("asked", F.lit(True))
    classes = cut_lineage(few.join(asked, "embedding", "left").select(F.col("ids")[0].alias("cid"), "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")))
    return classes, asking.join(classes.select("embedding", "cid"), "embedding").select("vec_id", "cid")


def _ranks(classes: DataFrame, curves: list[Curve], longest: float) -> DataFrame:
    """(curve, kind, cid, pos): the place of every class, and of every query, in each order."""
    keys_schema = pa.schema([("curve", pa.int32()), ("key", pa.int64()), ("kind", pa.int32()), ("cid", pa.int64())])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cid, asked = _matrix(batch.column("embedding"), batch.num_rows), np.asarray(batch.column("cid")), np.asarray(batch.column("asked").to_numpy(zero_copy_only=False), bool)
            norm = np.sqrt((x * x).sum(1))
            data = np.column_stack([x, np.sqrt(np.maximum(longest**2 - norm**2, 0))])
            query = np.column_stack([x * (longest / np.maximum(norm, 1e-300))[:, None], np.zeros(len(x))])[asked]
            for c, curve in enumerate(curves):
                for kind, points, ids in ((0, data, cid), (1, query, cid[asked])):
                    if len(points):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), c, np.int32)), pa.array(curve.keys(points)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids)], schema=keys_schema)

    places = pa.schema([("curve", pa.int32()), ("kind", pa.int32()), ("cid", pa.int64()), ("pid", pa.int64()), ("nth", pa.int64())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pid = np.zeros(len(curves), np.int64), TaskContext.get().partitionId()
        for batch in batches:
            curve = np.asarray(batch.column("curve"))
            nth = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                mine = np.flatnonzero(curve == c)
                nth[mine] = seen[c] + np.arange(len(mine))
                seen[c] += len(mine)
            yield pa.RecordBatch.from_arrays([batch.column("curve"), batch.column("kind"), batch.column("cid"), pa.array(np.full(len(curve), pid)), pa.array(nth)], schema=places)

    keys = cut_lineage(classes.mapInArrow(keyed, "curve int, key long, kind int, cid long"))
    order = ["curve", "key", "kind", "cid"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_keys.mapInArrow(counted, "curve int, kind int, cid long, pid long, nth long"))
    before = Window.partitionBy("curve").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("curve", "pid").count().select("curve", "pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["curve", "pid"]).select("curve", "kind", "cid", (F.col("start") + F.col("nth")).alias("pos"))


def _true_neighbours(classes: DataFrame, k: int, probes: int) -> DataFrame:
    """(qcid, ccid): the k classes nearest to each of a few asked classes, itself aside, by one exact pass over all classes."""
    asked = classes.filter("asked").orderBy(F.xxhash64("cid"), "cid").limit(probes).select("cid", "embedding").collect()
    shared = classes.sparkSession.sparkContext.broadcast((np.array([r["cid"] for r in asked]), np.array([r["embedding"] for r in asked], float)))
    schema = pa.schema([("qcid", pa.int64()), ("ccid", pa.int64()), ("score", pa.float64())])

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                cid = np.asarray(batch.column("cid"))
                score = q @ _matrix(batch.column("embedding"), batch.num_rows).T
                score[ids[:, None] == cid[None, :]] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(score, top, 1).ravel()
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])[keep]), pa.array(cid[top.ravel()][keep]), pa.array(best[keep])], schema=schema)

    found = classes.select("cid", "embedding").mapInArrow(nearest, "qcid long, ccid long, score double")
    best = F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), "ccid"))
    return found.withColumn("n", best).filter(F.col("n") <= k).select("qcid", "ccid")


def fitted_window(classes: DataFrame, ranks: DataFrame, k: int, index: CurveIndex) -> int:
    """The least window that holds the share `target` of the probes' true neighbours in one of the orders."""
    pairs = cut_lineage(_true_neighbours(classes, k, index.probes))
    at = ranks.filter("kind = 1").select("curve", F.col("cid").alias("qcid"), F.col("pos").alias("at"))
    to = ranks.filter("kind = 0").select("curve", F.col("cid").alias("ccid"), F.col("pos").alias("to"))
    apart = F.broadcast(pairs).join(at, "qcid")  # at most probes * k rows
    apart = F.broadcast(apart).join(to, ["curve", "ccid"]).groupBy("qcid", "ccid").agg(F.min(F.abs(F.col("at") - F.col("to"))).alias("apart"))
    seen = np.sort([r["apart"] for r in apart.collect()])
    return max(index.least_window, int(seen[max(0, math.ceil(index.target * len(seen)) - 1)])) if len(seen) else index.least_window


def search(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 20, index: CurveIndex | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best by inner product for each row whose vec_id is divisible by `every`.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than the
    commonest, nor rows without vec_id; of rows with one vec_id the smallest vector counts. Equal scores go to the smaller
    vec_id. An empty table gives an empty result. Other columns are ignored.

    The window is fitted on a bounded number of queries to hold the share `target` of the true neighbours; every row is indexed
    and every query is answered. A class of equal vectors carries its k + 1 smallest ids, which is all that any answer can need of it. Blocks hold at most
    `block` ranks, and queries come to a block at most about `queries_at_once` at a time.
    """
    index = index or CurveIndex()
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    classes, queries = vector_classes(vectors, k, every)
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not stats["n"]:
        return spark.createDataFrame([], out)
    longest = math.sqrt(stats["m"])
    sample = np.array([r["embedding"] for r in classes.orderBy(F.xxhash64("cid"), "cid").select("embedding").limit(index.fit_rows).collect()])
    sample = np.column_stack([sample, np.sqrt(np.maximum(longest**2 - (sample**2).sum(1), 0))])
    ranks = cut_lineage(_ranks(classes, fit_curves(sample, index), longest))
    total = stats["n"] + stats["asked"]
    window = fitted_window(classes, ranks, k, index)
    visits = stats["asked"] * min(1.0, (2 * window + index.block) / total)
    chunks = max(1, math.ceil(visits / index.queries_at_once))
    block = lambda pos: F.floor(pos / index.block)
    pos, last = F.col("pos"), (total - 1) // index.block
    data = ranks.filter("kind = 0").withColumn("block", block(pos)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    ask = ranks.filter("kind = 1").withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), block(pos - window)), F.least(F.lit(last).cast("long"), block(pos + window)))))
    ask = ask.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int"))
    columns = ["curve", "block", "chunk", "kind", "cid", "pos"]
    rows = data.select(columns).unionByName(ask.select(columns)).join(classes.select("cid", "embedding"), "cid")
    found_schema = pa.schema([("qcid", pa.int64()), ("ccid", pa.int64()), ("score", pa.float64())])

    def best(group: pa.Table) -> pa.Table:
        kind, cid, at = (np.asarray(group.column(c).combine_chunks()) for c in ("kind", "cid", "pos"))
        x = _matrix(group.column("embedding").combine_chunks(), len(kind))
        d, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        d = d[np.argsort(cid[d], kind="stable")]
        base, qs, cs, ss = np.ascontiguousarray(x[d]), [], [], []
        for a in range(0, len(q) if len(d) else 0, 256):
            part = q[a : a + 256]
            score = x[part] @ base.T
            score[np.abs(at[part][:, None] - at[d][None, :]) > window] = -np.inf
            keep = min(k + 1, len(d))
            floor = np.partition(score, -keep, axis=1)[:, -keep]
            for i, p in enumerate(part):
                some = np.flatnonzero((score[i] >= floor[i] - 1e-9 * (1 + abs(floor[i]))) & np.isfinite(score[i])) if np.isfinite(floor[i]) else np.flatnonzero(np.isfinite(score[i]))
                exact = (base[some] * x[p]).sum(1)
                top = np.lexsort((cid[d[some]], -exact))[: k + 1]
                qs.append(np.full(len(top), cid[p]))
                cs.append(cid[d[some[top]]])
                ss.append(exact[top])
        return pa.table([np.concatenate(v) if v else np.zeros(0, t) for v, t in ((qs, np.int64), (cs, np.int64), (ss, np.float64))], schema=found_schema)

    found = rows.groupBy("curve", "block", "chunk").applyInArrow(best, "qcid long, ccid long, score double")
    pairs = found.groupBy("qcid", "ccid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qcid").orderBy(F.desc("score"), "ccid")
    top = pairs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1)
    members = top.join(classes.select(F.col("cid").alias("ccid"), "ids"), "ccid").select("qcid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qcid").orderBy(F.desc("score"), "vec_id")
    lists = members.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k + 1).groupBy("qcid").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("best"))
    answered = queries.join(lists, queries["cid"] == lists["qcid"]).select(queries["vec_id"].alias("query_id"), "best")
    kept = answered.select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return kept.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def op9_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return search(read_table(spark, sf_dir, "embeddings"))
