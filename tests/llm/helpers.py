"""Awkward rows that every operator must take."""

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """documents from (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows], COLUMNS)


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, a null id, one long text, and columns with names that operators use."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two three four five six"), (6, long), (7, "ünïcödé ßtraße 日本語 \U0001f600"), (None, "no id here at all"), (8, "1234 !!!")]
    docs = documents(spark, rows)
    return docs.withColumns({c: F.lit("clash") for c in ("rep", "component_id", "kept", "start", "length", "size", "slot", "shard", "score", "gid", "label", "toxic", "bin", "pid")})


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
