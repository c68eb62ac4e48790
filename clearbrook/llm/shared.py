"""Helpers that several training-data operators use."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else the context's own; raises if there is none, as a local folder isn't seen by other executors."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and a lost executor costs nothing before it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Arrow batches hold rows of so many bytes; a row that is larger is one of its own.
BATCH_BYTES = "4m"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded size: sets the session's limit of bytes where none is set, as 10,000 long texts are too much for a task."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def _aside(columns: list[str], names: list[str]) -> dict[str, str]:
    taken, renamed = {c.lower() for c in columns} | {n.lower() for n in names}, {}
    for c in columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            renamed[c] = new
    return renamed


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of ``df`` that an operator's outputs would clash with are kept as ``<name>_in`` (``_in_in`` and so on if that is taken)."""
    renamed = _aside(df.columns, names)
    return df.withColumnsRenamed(renamed) if renamed else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with ``_`` in front until no column of ``df`` has them: for columns that an operator drops again."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def given(out: DataFrame, df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``df`` as they were, from the result of an operator that has set aside those named like its outputs ``names``."""
    renamed = _aside(df.columns, names)
    return out.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in df.columns])


def schema_with(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` and the columns of a DDL string after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def crc_of_id(key: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def held_out(key: Column) -> Column:
    """True for the third of the documents that no model learns from."""
    return F.pmod(crc_of_id(key), F.lit(3)) == 1


def ascii_words(text: Column) -> Column:
    """Runs of characters other than space, tab, newline, vertical tab, form feed and carriage return."""
    return F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
