import time

import pytest

from quarrylight.sources.tables import table
from quarrylight.streaming import events, state


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def test_tumbling_stream_equals_batch(spark, sf_dir):
    got = {tuple(r) for r in drain(events.tumbling(stream(spark, sf_dir)), "tumbling").collect()}
    want = {tuple(r) for r in events.tumbling(table(spark, sf_dir, "events")).collect()}
    assert got and got <= want
    last = max(w[0]["end"] for w in want)
    assert {w for w in want if (last - w[0]["end"]).days >= 2} <= got


def test_repeats_are_dropped(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    assert drain(events.without_repeats(stream(spark, sf_dir)), "unique").count() == n


def test_overlay_is_idempotent(spark, tmp_path):
    write = events.overlay_writer(str(tmp_path), "k", ["seq"])
    batch = spark.createDataFrame([(1, 1, "old"), (1, 2, "new")], "k int, seq int, v string")
    write(batch, 0)
    write(batch, 0)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path)).select("k", "seq", "v").collect()] == [(1, 2, "new")]


def files(spark, tmp_path, batches, schema):
    """A stream that reads one file for each batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_buffers_fill_and_wait(spark, tmp_path):
    source = files(spark, tmp_path, [[("a", i) for i in range(5)], [("a", i) for i in range(5, 12)] + [("b", 1)], [("a", i) for i in range(12, 20)]], "k string, i long")
    got = {(r["key"], r["nth"]): list(r["ids"]) for r in drain(state.buffered(source, "k", "i"), "buffered").collect()}
    assert sorted(got) == [("a", 0), ("a", 1)] and all(len(v) == 8 for v in got.values())
    assert len({x for v in got.values() for x in v}) == 16


def test_novelty_grows(spark, tmp_path):
    source = files(spark, tmp_path, [[("a", 1, [1.0, 0.0])], [("a", 2, [0.99, 0.1]), ("a", 3, [0.0, 1.0]), ("b", 4, [1.0, 0.0])]], "k string, i long, v array<double>")
    got = {r["id"]: r["accepted"] for r in drain(state.novel(source, "k", "i", "v", 0.9), "novel").collect()}
    assert set(got) == {1, 2, 3, 4} and got[3] and got[4] and got[1] != got[2]


def test_runs_stop_early(spark, tmp_path):
    values = [1.0, 2.0, 2.0, 1.5, 2.0, 9.0]
    source = files(spark, tmp_path, [[("r", i, v) for i, v in enumerate(values)]], "r string, s long, v double")
    got = {r["step"]: (r["best"], r["waited"], r["stop"]) for r in drain(state.early_stop(source, "r", "s", "v", 0.5, 3), "stops").collect()}
    assert got == {0: (1.0, 0, False), 1: (2.0, 0, False), 2: (2.0, 1, False), 3: (2.0, 2, False), 4: (2.0, 3, True), 5: (2.0, 3, True)}


def test_batches_resume_and_replace_themselves(spark, tmp_path):
    source = files(spark, tmp_path, [[(1,)], [(2,)], [(3,)], [(4,)]], "i long")
    out = str(tmp_path / "out")
    write = state.batch_writer(out, every=3)
    for _ in range(2):  # the second query finds nothing left to do
        q = source.writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    assert [r["batch"] for r in spark.read.parquet(out).select("batch").distinct().collect()] == [2] and spark.read.parquet(out).count() == 3
    write.flush(spark, 3)
    rows = lambda: sorted((r["i"], r["batch"]) for r in spark.read.parquet(out).collect())
    assert len(rows()) == 4 and {i for i, _ in rows()} == {1, 2, 3, 4}
    one = lambda i: spark.createDataFrame([(i,)], "i long")
    for _ in range(2):  # a batch that is tried again replaces itself
        write(one(50), 4)
        write(one(60), 5)
    assert [i for i, b in rows() if b == 5 and i >= 50] == [50, 60] and len(rows()) == 6


def test_a_folder_belongs_to_one_scope(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "i long")
    state.batch_writer(str(tmp_path / "out"), scope="a:1")(one, 0)
    state.batch_writer(str(tmp_path / "out"), scope="a:1")(one, 1)
    with pytest.raises(ValueError, match="belongs to a:1"):
        state.batch_writer(str(tmp_path / "out"), scope="b:1")(one, 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_the_rest_is_flushed(spark, tmp_path):
    source = files(spark, tmp_path, [[("a", i) for i in range(10)] + [("b", 1)], [("a", 10), ("a", None)], [("a", 11), ("b", None), ("c", None)]], "k string, i long")
    got = {(r["key"], r["nth"]): list(r["ids"]) for r in drain(state.buffered(source, "k", "i"), "flushed").collect()}
    groups = sorted((k, len(v)) for (k, _), v in got.items())
    assert {x for v in got.values() for x in v} >= set(range(11)) and groups.count(("a", 8)) == 1 and ("b", 1) in groups and not any(k == "c" for k, _ in groups)


def test_idle_keys_are_flushed(spark, tmp_path):
    source = files(spark, tmp_path, [[("a", 1), ("a", 2)]], "k string, i long")
    q = state.buffered(source, "k", "i", idle_ms=200).writeStream.format("memory").queryName("idle").trigger(processingTime="100 milliseconds").start()
    for _ in range(100):
        time.sleep(0.2)
        if spark.table("idle").count():
            break
    q.stop()
    assert [list(r["ids"]) for r in spark.table("idle").collect()] == [[1, 2]]
