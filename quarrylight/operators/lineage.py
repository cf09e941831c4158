"""Cutting lineage, joins that stay off the driver, and names that clash with none of the caller's."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder in spark.checkpoint.dir; only a local session without one (tests) gets a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrylight-"))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both sides at every size.

    Sizes behind a parse are estimated from the columns before it, and shuffled texts of few kinds compress to little, so that
    Spark would broadcast, through the driver, tables of as many rows as the input.
    """
    return df.hint("merge")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
