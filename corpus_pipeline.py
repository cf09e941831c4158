"""A corpus pipeline: language identification, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents, whatever further columns those have. An empty table stays empty in every stage. Rows that are kept are kept as they
are, but for the texts that redaction changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import decontamination, languages, neardup, packing, secrets
from quarrylight.llm.common import read_table, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null and empty texts, texts without letters, and those of no clear language, go. A row without doc_id or lang is judged like
    others, by its text; repeated rows stay repeated.
    """
    return languages.keep_identified(docs, languages.fitted(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, by shingles of five words and a similarity of 0.8.

    Null texts and texts without words are linked with nothing and stay; so do rows without doc_id, which are not compared. Of
    rows that share a kept doc_id one stays, the first by text.
    """
    return neardup.deduplicated(docs, neardup.NearDup(words=5, percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts stay; null items find nothing. Each row is judged by its own text, also where a doc_id is null or shared.
    """
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars following a changed text; null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a null or empty text is one piece of the end id.

    Repeated rows, and rows without doc_id, are documents of their own.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: A random field and a subword tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again.

    A stage's table is removed once the next one is written; the last one is the result and stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
