import hashlib

import pytest

from quarrylight.sources import sinks


def test_atomic_write_replaces_the_whole_table(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (5, 3):
        sinks.write_atomic(spark.range(n), path)
        assert spark.read.json(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_sources_round_trip(spark, tmp_path):
    rows = [("a", "def f():\n    return 1\n"), ("b", "x = 1")]
    sinks.write_sources(spark.createDataFrame(rows, "id string, code string"), str(tmp_path / "s"), "id", "code")
    got = {tuple(r) for r in sinks.read_sources(spark, str(tmp_path / "s"), "id", "code").collect()}
    assert got == set(rows)


def test_store_round_trip(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [0.5, 1.0], "winner")], "id long, v array<double>, kind string")
    sinks.save_store(vectors, spark.createDataFrame([(3, 1)], "attempts long, bugs long"), str(tmp_path / "m"))
    a, b = sinks.load_store(spark, str(tmp_path / "m"))
    assert a.collect() == vectors.collect() and tuple(b.first()) == (3, 1)


def test_guarded_reads(spark, tmp_path):
    path = str(tmp_path / "x.json")
    schema = "schema_version int, id string"
    with pytest.raises(FileNotFoundError):
        sinks.guarded(spark, path, schema, 1)
    empty = spark.createDataFrame([], schema)
    assert sinks.guarded(spark, path, schema, 1, empty) is empty
    (tmp_path / "x.json").write_text('[{"schema_version": 1, "id": "a"}]')
    assert sinks.guarded(spark, path, schema, 1).count() == 1
    with pytest.raises(ValueError):
        sinks.guarded(spark, path, schema, 2)


def test_a_crashed_write_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_atomic(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.before")  # as a crash between the two renames leaves it
    assert not sinks.exists(spark, path) and sinks.recovered(spark, path) and spark.read.json(path).count() == 3
    (tmp_path / "t").rename(tmp_path / "t.before")
    sinks.write_atomic(spark.range(5), path)
    assert spark.read.json(path).count() == 5 and not (tmp_path / "t.before").exists()


def test_lines_of_many_parts_become_an_array(spark, tmp_path):
    import json

    spark.range(50).selectExpr("to_json(struct(id)) AS value").repartition(5).write.text(str(tmp_path / "lines"))
    sinks.lines_to_array(spark, str(tmp_path / "lines"), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert sorted(x["id"] for x in json.loads("".join(p.read_text() for p in parts))) == list(range(50))
    (tmp_path / "empty.jsonl").write_text("\n")
    sinks.lines_to_array(spark, str(tmp_path / "empty.jsonl"), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


def test_lines_become_an_array(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    sinks.lines_to_array(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "out"))
    assert sorted(r["a"] for r in spark.read.option("multiLine", True).json(str(tmp_path / "out")).collect()) == [1, 2]


def test_digests_of_files(spark, tmp_path):
    files = {"a.py": b"x = 1\n", "b.py": b"y", "c.txt": b"no"}
    for n, c in files.items():
        (tmp_path / n).write_bytes(c)
    found = sinks.file_digests(spark, str(tmp_path), "*.py")
    assert {r["name"]: (r["size"], r["sha256"]) for r in found.collect()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items() if n.endswith("py")}
    one = sinks.tree_digest(found)
    manifest = spark.createDataFrame([tuple(r) for r in found.select("name", "sha256").collect()], "name string, sha256 string")
    assert sinks.changed_files(found, manifest).isEmpty()
    (tmp_path / "b.py").write_bytes(b"changed")
    assert sinks.tree_digest(sinks.file_digests(spark, str(tmp_path), "*.py")) != one
    assert [r["name"] for r in sinks.changed_files(sinks.file_digests(spark, str(tmp_path), "*.py"), manifest).collect()] == ["b.py"]
