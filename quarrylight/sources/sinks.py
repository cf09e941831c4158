"""Sinks that a reader never sees half done, stores that are read back, and digests of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _system(spark, path)
    return system.exists(at)


def write_atomic(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a table beside its place and rename it there.

    The table that was there is renamed aside before and deleted last, so that at every moment one of them is whole on disk: a
    crash between the two renames leaves the old one at `<path>.before`, which the next write, or `recovered`, puts back.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.format(form).save(beside)
    recovered(spark, path)
    at, system = _system(spark, path)
    before = _system(spark, f"{path}.before")[0]
    if system.exists(at) and not system.rename(at, before):
        raise OSError(f"could not rename {path}")
    if not system.rename(_system(spark, beside)[0], at):
        raise OSError(f"could not rename {beside}")
    system.delete(before, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether a table is at its path, after what a crashed write left aside is put back or removed."""
    at, system = _system(spark, path.rstrip("/"))
    before = _system(spark, f"{path.rstrip('/')}.before")[0]
    if system.exists(before):
        if system.exists(at):
            system.delete(before, True)
        else:
            system.rename(before, at)
    return system.exists(at)


def write_sources(df: DataFrame, path: str, ident: str, code: str) -> None:
    """One folder for each row, named by its id, with the source as text."""
    df.select(F.col(ident).cast("string").alias(ident), F.col(code).alias("value")).write.mode("overwrite").partitionBy(ident).text(path)


def read_sources(spark: SparkSession, path: str, ident: str, code: str) -> DataFrame:
    return spark.read.schema(f"value string, `{ident}` string").text(path, wholetext=True).select(ident, F.regexp_replace("value", r"\n\z", "").alias(code))


def save_store(vectors: DataFrame, stats: DataFrame, path: str) -> None:
    """A store of vectors with metadata, and its statistics: both are written, the statistics last."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/stats")


def guarded(spark: SparkSession, path: str, schema: str, version: int, fallback: DataFrame | None = None) -> DataFrame:
    """JSON rows of one schema version; the fallback where there is no file; any other version raises."""
    if not exists(spark, path):
        if fallback is None:
            raise FileNotFoundError(path)
        return fallback
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    if not rows.filter(~F.col("schema_version").eqNullSafe(version)).isEmpty():
        raise ValueError(f"{path} is not of schema version {version}")
    return rows


def lines_to_array(spark: SparkSession, source: str, path: str) -> None:
    """JSON lines as one JSON array: the parts of a folder, which make the array when they are put one after another by name.

    Every task writes its own lines with the commas between them; the first line of all opens the array and the last closes
    it, found by their numbers. Blank lines are left out, as in the source's own reading; no lines make an empty array.
    """
    lines = spark.read.text(source).filter(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    ends = lines.agg(F.min("_id").alias("first"), F.max("_id").alias("last")).first()
    if ends["first"] is None:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    head = F.when(F.col("_id") == ends["first"], "[").otherwise("")
    tail = F.when(F.col("_id") == ends["last"], "]").otherwise(",")
    lines.select(F.concat(head, F.trim("value"), tail).alias("value")).write.mode("overwrite").text(path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, size, sha256) of the files below a folder, hashed where they are read. Spark leaves out files without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def tree_digest(digests: DataFrame) -> str:
    """One digest of a folder: of each file's name and digest, with their lengths, in order of name. For folders of source
    files, whose list the driver holds."""
    line = F.concat_ws(":", F.length("name").cast("string"), "name", F.col("size").cast("string"), "sha256")
    return digests.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d")).first()["d"]


def changed_files(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, recorded, sha256) of files that are missing, new, or differ from the manifest (name, sha256)."""
    both = digests.select("name", "sha256").join(manifest.select("name", F.col("sha256").alias("recorded")), "name", "full_outer")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("recorded"))).select("name", "recorded", "sha256")
