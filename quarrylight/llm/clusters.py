"""Centroid clustering in exact integers, with Hamerly's bounds.

Every vector carries its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of the distance to
the second nearest. When centroids move, the bounds are loosened by how far they moved; while the upper one stays below the
lower one, or below half the distance to the nearest other centroid, the vector keeps its cluster unseen. What is left is
scanned in full, in integers, so rounding decides nothing: bounds err on the side of a scan.

The state is a table in the shared folder, written anew each round from the one before, so a lost executor costs one task.
Centroids are k rows on the driver. Only vectors that changed their cluster are read to update the sums, which leave each task
as at most k rows; no row of the table is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import read_table, shared_folder

#: Up to this size of a component, squared distances of MAX_DIMENSIONS components fit 64-bit integers.
SAFE, MAX_DIMENSIONS = 2.0**27, 64
#: What bounds are widened by, relatively; the roots and sums behind them are right to about 2 ** -52.
SLACK = 2.0**-40
LONG = 2**63 - 1


@dataclass(frozen=True)
class Clustering:
    k: int = 8
    rounds: int = 10
    dimensions: int = 64
    scale: int = 1024
    seed: int = 3


Centroids = list[list[int]]


def squares(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Exact squared distances (rows x centroids) of vectors whose components are whole numbers held in doubles.

    Small components are taken as 64-bit integers; where one is so large that this could overflow, as Python's.
    """
    small = x.shape[1] <= MAX_DIMENSIONS and all(abs(v) <= SAFE for c in centroids for v in c) and bool((np.abs(x) <= SAFE).all())
    if small:
        own, out = x.astype(np.int64), np.empty((len(x), len(centroids)), np.int64)
        for j, c in enumerate(centroids):
            d = own - np.array(c, np.int64)
            out[:, j] = np.einsum("ij,ij->i", d, d)
        return out
    rows = [[int(v) for v in r] for r in x.tolist()]
    return np.array([[sum((a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in centroids] for r in rows], object).reshape(len(x), len(centroids))


def root(square: int) -> float:
    """The square root of a whole number of any size; inf beyond a double."""
    return math.sqrt(square) if square < 2**1000 else float(math.isqrt(square)) if square < 2**2040 else math.inf


def roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared) if squared.dtype != object else np.array([root(v) for v in squared.ravel()], float).reshape(squared.shape)


@dataclass
class Moves:
    """How far centroids moved in a round, and half of each centroid's distance to its nearest neighbour."""

    drift: list[float]
    half: list[float]

    @staticmethod
    def between(old: Centroids, new: Centroids) -> Moves:
        gap = lambda a, b: root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))
        halves = [min((gap(c, d) for j, d in enumerate(new) if i != j), default=math.inf) / 2 for i, c in enumerate(new)]
        return Moves([gap(a, b) * (1 + SLACK) for a, b in zip(old, new, strict=True)], [h * (1 - SLACK) for h in halves])


def assigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids, moves: Moves) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after the centroids moved. A cluster of -1 has not been assigned yet.

    A vector keeps its cluster only if its upper bound is truly below, so ties always come to the scan, where the smaller
    number wins.
    """
    drift, half = np.array(moves.drift), np.array(moves.half)
    known = cluster >= 0
    own = np.where(known, cluster, 0)
    far = np.sort(drift)[::-1]
    others = np.where((drift[own] == far[0]) & (len(drift) > 1), far[1] if len(far) > 1 else 0.0, far[0])
    upper = np.where(known, (upper + drift[own]) * (1 + SLACK), math.inf)
    lower = np.where(known, np.maximum(lower - others, 0.0) * (1 - SLACK), 0.0)
    limit = np.maximum(lower, half[own])
    doubt = ~(upper < limit)
    if (check := np.flatnonzero(doubt & known)).size:  # the true distance to the own centroid may settle it
        for c in np.unique(own[check]).tolist():
            rows = check[own[check] == c]
            upper[rows] = roots(squares(x[rows], [centroids[c]])[:, 0]) * (1 + SLACK)
        doubt[check] = ~(upper[check] < limit[check])
    scan = np.flatnonzero(doubt)
    cluster = cluster.copy()
    if scan.size:
        d = squares(x[scan], centroids)
        best = d.argmin(1)
        cluster[scan] = best
        at = np.arange(len(scan))
        upper[scan] = roots(d[at, best]) * (1 + SLACK)
        if len(centroids) > 1:
            second = np.array([min(v for j, v in enumerate(r) if j != b) for r, b in zip(d, best, strict=True)], object) if d.dtype == object else np.where(np.arange(d.shape[1]) == best[:, None], LONG, d).min(1)
            lower[scan] = roots(second) * (1 - SLACK)
        else:
            lower[scan] = math.inf
    return cluster, upper, lower, doubt


STATE = "vec_id long, q array<double>, cluster int, before int, upper double, lower double"


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _step(centroids: Centroids, moves: Moves):
    def advance(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                before = np.asarray(b.column("cluster"))
                cluster, upper, lower, _ = assigned(_matrix(b.column("q")), before, np.asarray(b.column("upper")), np.asarray(b.column("lower")), centroids, moves)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), *map(pa.array, (cluster.astype(np.int32), before, upper, lower))], ["vec_id", "q", "cluster", "before", "upper", "lower"])

    return advance


def _changes(k: int, dimensions: int):
    """What each task's moved vectors add to the rows and sums of every cluster, exactly: at most k rows a task."""

    def change(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = [0] * k, [[0] * dimensions for _ in range(k)]
        touched: set[int] = set()
        for b in batches:
            x = _matrix(b.column("q")) if b.num_rows else np.zeros((0, dimensions))
            # Up to 2 ** 16 rows of components below 2 ** 46 have an exact sum in 64 bits.
            small = bool((np.abs(x) < 2.0**46).all()) and len(x) <= 1 << 16
            for name, sign in (("cluster", 1), ("before", -1)):
                of = np.asarray(b.column(name))
                for c in np.unique(of[of >= 0]).tolist():
                    part = x[of == c]
                    total = part.astype(np.int64).sum(0).tolist() if small else [sum(int(v) for v in column) for column in part.T.tolist()]
                    rows[c] += sign * len(part)
                    sums[c] = [s + sign * t for s, t in zip(sums[c], total, strict=True)]
                    touched.add(c)
        for c in sorted(touched):
            yield pa.RecordBatch.from_pylist([{"cluster": c, "n": rows[c], "sums": [str(s) for s in sums[c]]}], schema=_CHANGE)

    return change


_CHANGE = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _added(part: pd.DataFrame) -> pd.DataFrame:
    """The tasks' changes of one cluster as one row."""
    total = [sum(map(int, column)) for column in zip(*part["sums"], strict=True)]
    return pd.DataFrame({"cluster": part["cluster"][:1], "n": [int(part["n"].sum())], "sums": [[str(v) for v in total]]})


def quantised(vectors: DataFrame, p: Clustering) -> DataFrame:
    """(vec_id, q, drawn) of the vectors that take part: all components there and finite, floor(scale * x) as a double."""
    x = F.col("embedding").cast("array<double>")
    q = F.transform(x, lambda v: _floor(v * F.lit(float(p.scale))))
    sound = (F.size(x) == p.dimensions) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) * p.scale < F.lit(math.inf)), F.lit(False)))
    ident = F.coalesce(F.col("vec_id").cast("string"), F.lit(""))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"), F.sha2(F.concat(F.lit(f"{p.seed}:"), ident), 256).alias("drawn"))


def _floor(v):
    """floor as a double: Spark's gives a long, which large doubles don't fit."""
    whole = F.rint(v)
    return F.when(whole > v, whole - 1).otherwise(whole)


class _States:
    """Tables of one run in the shared folder; an older one goes once the next is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.nth = spark, f"{shared_folder(spark)}/clusters/{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.nth += 1
        df.write.option("compression", "zstd").parquet(f"{self.root}/state={self.nth}")
        if self.nth > 1:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state={self.nth - 1}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(STATE).parquet(f"{self.root}/state={self.nth}")


def cluster_vectors(vectors: DataFrame, params: Clustering | None = None) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids.

    A vector takes part if it has exactly `dimensions` components, none null, NaN or infinite, nor infinite once scaled.
    Repeated rows are vectors of their own. Ties between hashes of the draw (a repeated vec_id, or none) go by components, and
    equal rows may each be drawn. With fewer than k vectors there are fewer centroids; without any the result is empty. A
    squared distance beyond a long is null; the assignment is exact all the same. Other columns are ignored.
    """
    p = params or Clustering()
    spark = vectors.sparkSession
    kept, states = quantised(vectors, p), _States(spark)
    centroids = [[int(v) for v in r["q"]] for r in kept.orderBy("drawn", "q").limit(p.k).select("q").collect()]
    unknown = [F.lit(-1).cast("int").alias("cluster"), F.lit(-1).cast("int").alias("before"), F.lit(math.inf).alias("upper"), F.lit(0.0).alias("lower")]
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    k = len(centroids)
    state, moves = kept.select("vec_id", "q", *unknown), Moves.between(centroids, centroids)
    rows, sums = [0] * k, [[0] * p.dimensions for _ in range(k)]
    for _ in range(p.rounds):
        state = states.written(state.mapInArrow(_step(centroids, moves), STATE))
        moved = state.filter("cluster <> before").select("q", "cluster", "before").mapInArrow(_changes(k, p.dimensions), "cluster int, n long, sums array<string>")
        for r in moved.groupBy("cluster").applyInPandas(_added, "cluster int, n long, sums array<string>").collect():
            c = r["cluster"]
            rows[c] += r["n"]
            sums[c] = [a + int(b) for a, b in zip(sums[c], r["sums"], strict=True)]
        new = [[s // rows[c] for s in sums[c]] if rows[c] else centroids[c] for c in range(k)]
        moves, centroids = Moves.between(centroids, new), new
    state = states.written(state.mapInArrow(_step(centroids, moves), STATE))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cluster = _matrix(b.column("q")) if b.num_rows else np.zeros((0, p.dimensions)), np.asarray(b.column("cluster"))
            out: list = [None] * len(x)
            for c in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == c)
                for i, d in zip(at.tolist(), squares(x[at], [centroids[c]])[:, 0].tolist(), strict=True):
                    out[i] = d if d <= LONG else None
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(out, pa.int64())], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "q", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long"), centroids


def with_inertia(found: DataFrame, centroids: Centroids) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256. Sums are exact; one that is beyond a long, or holds a null, is null."""
    wide = F.col("distance").cast("decimal(19,0)")
    sums = {r["cluster"]: None if r["missing"] else int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(wide).alias("total"), F.count_if(F.col("distance").isNull()).alias("missing")).collect()}
    whole = None if None in sums.values() else sum(sums.values())
    fits = lambda v: F.lit(v if v is not None and v <= LONG else None).cast("long")
    if not centroids:
        return found.select("*", fits(None).alias("cluster_inertia"), fits(None).alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    at = F.col("cluster") + 1
    own = F.element_at(F.array(*(fits(sums.get(c, 0)) for c in range(len(centroids)))), at)
    return found.select("*", own.alias("cluster_inertia"), fits(whole).alias("inertia"), F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"))


def op13_hamerly_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 8 clusters after 10 rounds."""
    found, centroids = cluster_vectors(read_table(spark, sf_dir, "embeddings"))
    return with_inertia(found, centroids)


def sql(p: Clustering) -> str:
    """The same in DuckDB: every round scans every vector; sums are hugeints, quotients are floored."""
    def scan(i: int) -> str:
        square = "list_sum(list_transform(list_zip(v.q, m.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min(j, d * {p.k} + j) AS j, min(d) AS d FROM (SELECT v.row, v.vec_id, v.q, m.j, {square} AS d FROM v, m{i} m) GROUP BY row)"

    def update(i: int) -> str:
        mean = "(s - ((s % n) + n) % n) // n"
        parts = f"SELECT j, x, sum(q[x])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {p.dimensions + 1}) r(x) GROUP BY j, x"
        return f"m{i + 1} AS MATERIALIZED (SELECT o.j, coalesce(w.c, o.c) AS c FROM m{i} o LEFT JOIN (SELECT j, list(({mean})::BIGINT ORDER BY x) AS c FROM ({parts}) GROUP BY j) w USING (j))"

    finite = f"len(embedding) = {p.dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {p.dimensions}"
    head = f"v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {finite})"
    first = f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS j, q AS c FROM v QUALIFY j < {p.k})"
    steps = [f"{scan(i)}, {update(i)}" for i in range(p.rounds)]
    ends = f"SELECT vec_id, a.j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{p.rounds} a JOIN m{p.rounds} m ON a.j = m.j"
    return "WITH " + ", ".join([head, first, *steps, scan(p.rounds)]) + " " + ends


OP13_SQL = sql(Clustering())
