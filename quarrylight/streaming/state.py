"""Streams with state: buffers that are trained on when full, resumable progress, growing novelty, early stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.sources.sinks import exists


class BatchWriter:
    """For foreachBatch: rows are gathered and written every `every` batches, under the id of the last of them.

    Each batch waits under its own id, so a batch that is tried again replaces itself, and so does a group that is written
    again after a restart. `flush` writes what still waits; no row is lost whatever `every` is. The folder belongs to one
    scope (what is trained on what): a writer of another scope is refused.
    """

    def __init__(self, path: str, every: int = 1, scope: str | None = None) -> None:
        self.path, self.every, self.scope = path.rstrip("/"), every, scope

    def _checked(self, spark: SparkSession) -> None:
        if self.scope is None:
            return
        place = f"{self.path}/_scope"
        if exists(spark, place):
            known = spark.read.text(place, wholetext=True).first()[0].rstrip("\n")
            if known != self.scope:
                raise ValueError(f"{self.path} belongs to {known}, not to {self.scope}")
        else:
            spark.createDataFrame([(self.scope,)], "value string").coalesce(1).write.text(place)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self._checked(spark)
        if self.every == 1:
            batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/_waiting/{batch_id}")
        if (batch_id + 1) % self.every == 0:
            self._write(spark, batch_id)

    def _write(self, spark: SparkSession, last: int) -> None:
        first = last - last % self.every
        waiting = [f"{self.path}/_waiting/{i}" for i in range(first, last + 1) if exists(spark, f"{self.path}/_waiting/{i}")]
        if waiting:
            spark.read.parquet(*waiting).write.mode("overwrite").parquet(f"{self.path}/batch={last - last % self.every + self.every - 1}")

    def flush(self, spark: SparkSession, last: int) -> None:
        """Write the group of batch `last`, the last one, though it isn't full. The next batch of the group writes it anew."""
        if self.every > 1:
            self._write(spark, last)


def batch_writer(path: str, every: int = 1, scope: str | None = None) -> BatchWriter:
    return BatchWriter(path, every, scope)


def buffered(stream: DataFrame, key: str, ident: str, size: int = 8, idle_ms: int | None = None) -> DataFrame:
    """(key, nth, ids): the ids of each key in groups of `size`, as they fill; a smaller rest waits in the state.

    A row with a null id ends a key: what waits is given as a last, smaller group. With idle_ms, so does a key to which nothing
    has come for that time. The state holds the waiting ids of one key, fewer than `size`, and the number of the next group.
    """

    def fill(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, nth = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = [x for b in batches for x in b[ident]]
        new = sorted(int(x) for x in rows if not pd.isna(x))
        waiting += new
        full = []
        while len(waiting) >= size:
            full.append((k[0], nth, waiting[:size]))
            waiting, nth = waiting[size:], nth + 1
        if waiting and (state.hasTimedOut or len(new) < len(rows)):
            full.append((k[0], nth, waiting))
            waiting, nth = [], nth + 1
        state.update((waiting, nth))
        if idle_ms is not None and waiting:
            state.setTimeoutDuration(idle_ms)
        if full:
            yield pd.DataFrame(full, columns=["key", "nth", "ids"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias(ident)).groupBy("key").applyInPandasWithState(fill, "key string, nth long, ids array<long>", "waiting array<long>, nth long", "append", timeout)


def novel(stream: DataFrame, key: str, ident: str, vector: str, threshold: float) -> DataFrame:
    """(key, id, accepted): whether each vector is unlike all that its key accepted before, in order of id within a batch.

    The state of a key grows with what it accepts, which is what a novelty memory is.
    """

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, width = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = sorted(((int(i), list(v)) for b in batches for i, v in zip(b[ident], b[vector], strict=True)), key=lambda x: x[0])
        known, out = np.array(kept, float).reshape(-1, width) if width else None, []
        for i, v in rows:
            fresh = known is None or not len(known) or float((known @ np.array(v, float)).max()) < threshold
            out.append((k[0], i, fresh))
            if fresh:
                known = np.array([v], float) if known is None else np.vstack([known, v])
        state.update(([] if known is None else known.ravel().tolist(), 0 if known is None else known.shape[1]))
        yield pd.DataFrame(out, columns=["key", "id", "accepted"])

    own = stream.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias(ident), F.col(vector).cast("array<double>").alias(vector))
    return own.groupBy("key").applyInPandasWithState(judge, "key string, id long, accepted boolean", "kept array<double>, width int", "append", GroupStateTimeout.NoTimeout)


def early_stop(stream: DataFrame, run: str, step: str, value: str, min_gain: float, limit: int) -> DataFrame:
    """(run, step, best, waited, stop): a run stops after `limit` steps in a row that did not beat its best by `min_gain`.

    The state of a run is its best value and how long it has waited. Steps come in order; a stopped run stays stopped.
    """

    def watch(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, waited = state.get if state.exists else (None, 0)
        out = []
        for s, v in sorted((int(s), float(v)) for b in batches for s, v in zip(b[step], b[value], strict=True)):
            if waited < limit:
                gained = best is None or v - best >= min_gain
                best, waited = (v, 0) if gained else (best, waited + 1)
            out.append((k[0], s, best, waited, waited >= limit))
        state.update((best, waited))
        yield pd.DataFrame(out, columns=["run", "step", "best", "waited", "stop"])

    own = stream.select(F.col(run).cast("string").alias("run"), F.col(step).cast("long").alias(step), F.col(value).cast("double").alias(value))
    return own.groupBy("run").applyInPandasWithState(watch, "run string, step long, best double, waited long, stop boolean", "best double, waited long", "append", GroupStateTimeout.NoTimeout)
