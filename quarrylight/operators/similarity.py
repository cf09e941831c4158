"""Exact similarity over given vectors, in blocks of a stated query set."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.lineage import checkpointed, shuffled


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


#: Query vectors that are broadcast at one time (64 doubles each: 4 MB).
BLOCK = 8192


def _blocks(queries: DataFrame, ident: str) -> list[DataFrame]:
    n = -(-queries.count() // BLOCK)
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64(ident), F.lit(n)) == i) for i in range(n)]


def _vectors(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, held): one row for each vector, zeros where it is null, which held tells."""
    held = column.is_valid().to_numpy(zero_copy_only=False)
    flat = np.asarray(column.drop_null().flatten(), np.float64)
    out = np.zeros((len(held), len(flat) // held.sum() if held.any() else width))
    out[held] = flat.reshape(held.sum(), -1)
    return out, held


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner products of rows of a and b, summed from the first component to the last as dot() does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _length(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    return np.where(np.isfinite(n), n, 0.0)


#: Query vectors that meet a batch in one matrix product, and rows of a batch (16 MB of doubles at a time).
STRIP, ROWS = 512, 4096
_SCORED = "query_id long, vec_id long, score double"


def _top(ids: np.ndarray, x: np.ndarray, held: np.ndarray, q: np.ndarray, w: np.ndarray, known: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows for each query: the matrix product screens the pairs, within what its rounding may hide, and what is left
    is summed again in the order of dot(). Not a number comes first and null last, ties by id, as Spark and the SQL have it."""
    none = ids[:, None] == q
    scores, null = x @ w.T, ~(held[:, None] & known)
    scores[none | null] = -np.inf
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(~none & ((scores >= least - 1e-12 * _length(x).max() * _length(w)) | np.isnan(scores)))
    exact = np.concatenate([_summed(x[i[s : s + ROWS]], w[j[s : s + ROWS]]) for s in range(0, len(i), ROWS)] or [np.zeros(0)])
    gone = null[i, j]
    order = np.lexsort((ids[i], -exact, ~np.isnan(exact), gone, j))
    i, j = i[order], j[order]
    kept = np.arange(len(j)) - np.searchsorted(j, j) < k
    order, i, j = order[kept], i[kept], j[kept]
    return pa.RecordBatch.from_arrays([pa.array(q[j], pa.int64()), pa.array(ids[i], pa.int64()), pa.array(exact[order], pa.float64(), mask=gone[order], from_pandas=False)], names=["query_id", "vec_id", "score"])


def _best(queries: DataFrame, base: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each query the k best of each batch of base.

    base is dealt out, and the driver passes on one block of the bounded query set at a time. A vector that holds a null counts
    as null.
    """
    sound = F.when(~F.exists(F.col(vector), lambda x: x.isNull()), F.col(vector).cast("array<double>"))
    as_rows = lambda df: df.select(F.col(ident).cast("long").alias("id"), sound.alias("v")).filter("id IS NOT NULL")
    rows = as_rows(base).repartition(base.sparkSession.sparkContext.defaultParallelism)

    def against(shared):
        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, v, known = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    x, held = _vectors(batch.column("v"), v.shape[1])
                    w = v if v.shape[1] else np.zeros((len(own), x.shape[1]))
                    for s in range(0, len(own), STRIP):
                        yield _top(np.asarray(batch.column("id")), x, held, own[s : s + STRIP], w[s : s + STRIP], known[s : s + STRIP], k)

        return compare

    out = base.sparkSession.createDataFrame([], _SCORED)
    for block in _blocks(as_rows(queries), "id"):
        table = block.toArrow().combine_chunks()
        if table.num_rows:
            shared = base.sparkSession.sparkContext.broadcast((np.asarray(table.column("id")), *_vectors(table.column("v").combine_chunks())))
            out = out.unionByName(rows.mapInArrow(against(shared), _SCORED))
    return out


def nearest(queries: DataFrame, base: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of base for each row of a bounded query set, itself excluded, ties by id; null scores last."""
    top = _best(queries, base, ident, vector, k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def _raise(best: np.ndarray, ids: np.ndarray, x: np.ndarray, held: np.ndarray, q: np.ndarray, w: np.ndarray) -> None:
    """Raise the best score of each query to that of the rows with smaller ids, screened and summed as in _top; not a number is the greatest."""
    scores, open_ = x @ w.T, held[:, None] & (ids[:, None] < q)
    scores[~open_] = -np.inf
    least = np.maximum(scores.max(axis=0), best) - 1e-12 * _length(x).max() * _length(w)
    i, j = np.nonzero(open_ & ((scores >= least) | np.isnan(scores)))
    for s in range(0, len(i), ROWS):
        np.maximum.at(best, j[s : s + ROWS], _summed(x[i[s : s + ROWS]], w[j[s : s + ROWS]]))


def novelty(queries: DataFrame, base: DataFrame, ident: str, vector: str, threshold: float) -> DataFrame:
    """(id, best, novel) of each id of queries: the greatest similarity to any base vector of a smaller id, 0 without one.

    All pairs are compared, as the definition asks. The driver passes on one block of at most BLOCK queries at a time; each task
    keeps one number for each of them while it scans its share of base, in the order of ids, so that strips of queries which are
    all earlier than a batch are left out. Scores that have been found are written before the next block.
    """
    spark = base.sparkSession
    sound = F.when(~F.exists(F.col(vector), lambda x: x.isNull()), F.col(vector).cast("array<double>"))
    as_rows = lambda df: df.select(F.col(ident).cast("long").alias("id"), sound.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = checkpointed(as_rows(base).repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("id"))

    def against(shared):
        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, w = shared.value
            best, met = np.full(len(own), -np.inf), np.zeros(len(own), bool)
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    ids = np.asarray(batch.column("id"))
                    x, held = _vectors(batch.column("v"))
                    met |= own > ids.min()
                    for s in range(0, len(own), STRIP):
                        if ids.min() < own[s : s + STRIP].max():
                            _raise(best[s : s + STRIP], ids, x, held, own[s : s + STRIP], w[s : s + STRIP])
            yield pa.RecordBatch.from_arrays([pa.array(own[met], pa.int64()), pa.array(best[met], pa.float64(), from_pandas=False)], names=["query_id", "score"])

        return compare

    found = spark.createDataFrame([], "query_id long, score double")
    for block in _blocks(as_rows(queries), "id"):
        table = block.toArrow().combine_chunks().sort_by("id")
        if table.num_rows:
            shared = spark.sparkContext.broadcast((np.asarray(table.column("id")), _vectors(table.column("v").combine_chunks())[0]))
            scored = rows.mapInArrow(against(shared), "query_id long, score double")
            found = found.unionByName(checkpointed(scored.groupBy("query_id").agg(F.max("score").alias("score"))))
            shared.destroy()
    best = found.groupBy(F.col("query_id").alias("_i")).agg(F.max("score").alias("best"))
    of_ids = queries.select(ident).distinct().join(shuffled(best), F.col(ident) == F.col("_i"), "left")
    return of_ids.select(ident, F.coalesce("best", F.lit(0.0)).alias("best"), (F.col("best").isNull() | (F.col("best") < threshold)).alias("novel"))


def similar_pairs(vectors: DataFrame, ident: str, vector: str, threshold: float) -> DataFrame:
    """(a, b), a < b, of the ids whose vectors' inner product reaches the threshold; null vectors have none.

    All pairs are compared, as the definition asks: block by block of at most BLOCK vectors, which the driver passes on one at a
    time, each against all rows in matrix products of ROWS by STRIP.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = checkpointed(vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL"))
    matrix = lambda column, n: np.asarray(column.flatten(), np.float64).reshape(n, -1)

    def against(shared):
        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, own = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    other, x = np.asarray(batch.column("id")), matrix(batch.column("v"), batch.num_rows)
                    for at in range(0, len(ids), STRIP):
                        i, j = np.nonzero(x @ own[at : at + STRIP].T >= threshold)
                        later = other[i] < ids[at + j]
                        yield pa.RecordBatch.from_arrays([pa.array(other[i][later]), pa.array(ids[at + j][later])], schema=schema)

        return compare

    out = vectors.sparkSession.createDataFrame([], "a long, b long")
    for block in _blocks(rows, "id"):
        table = block.toArrow().combine_chunks()
        if table.num_rows:
            v = table.column("v").combine_chunks()
            shared = vectors.sparkSession.sparkContext.broadcast((np.asarray(table.column("id")), matrix(v, table.num_rows)))
            out = out.unionByName(checkpointed(rows.mapInArrow(against(shared), "a long, b long")))
            shared.destroy()
    return out


def novelty_insert(vectors: DataFrame, ident: str, vector: str, threshold: float) -> DataFrame:
    """Which vectors a store accepts that takes one only if nothing accepted before is as similar as the threshold.

    That is the lexicographically first independent set of the graph of similar pairs: in rounds, a vector without an open
    earlier neighbour is accepted and its later neighbours are rejected.
    """
    edges = checkpointed(similar_pairs(vectors, ident, vector, threshold))
    state = vectors.select(F.col(ident).alias("id"), F.lit("open").alias("state"))
    while True:
        live = edges.join(state.filter("state = 'open'").select(F.col("id").alias("a")), "a", "left_semi")
        blocked = live.select(F.col("b").alias("id")).distinct()
        fresh = state.filter("state = 'open'").join(blocked, "id", "left_anti").select("id").withColumn("new", F.lit(True))
        state = state.join(fresh, "id", "left").select("id", F.when(F.col("new"), "accepted").otherwise(F.col("state")).alias("state"))
        hit = edges.join(state.filter("state = 'accepted'").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct().withColumn("hit", F.lit(True))
        state = state.join(hit, "id", "left").select("id", F.when(F.col("hit") & (F.col("state") == "open"), "rejected").otherwise(F.col("state")).alias("state"))
        state = checkpointed(state)
        if state.filter("state = 'open'").isEmpty():
            return state.select(F.col("id").alias(ident), (F.col("state") == "accepted").alias("accepted"))
