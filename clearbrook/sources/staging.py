"""Intermediate tables that all executors can read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; raises if there is none, as a local folder isn't seen by other executors."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to that folder, and read again: what follows doesn't work it out anew, and a filter isn't pushed into it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_texts(df: DataFrame, name: str) -> str:
    """The path of text files with the lines of a table of one string column."""
    path = place(df.sparkSession, name)
    df.write.text(path)
    return path
