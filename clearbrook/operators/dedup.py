"""Duplicates, sorting, paging, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.names import set_aside, unused


def drop_exact(df: DataFrame) -> DataFrame:
    """Rows equal in all columns once; nulls are equal."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows): rows beyond the first of each set of equal ones."""
    n = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count()
    return n.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def near_duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with near_duplicate (an input column of that name stays as ``near_duplicate_in``): whether another row has the same ``keys`` (nulls equal). Counts are combined before the shuffle and joined back, so that a frequent key is no window in one task."""
    renamed = set_aside(df, ["near_duplicate"])
    keys, df = [renamed.columns[df.columns.index(k)] for k in keys], renamed
    names = unused([*df.columns, "near_duplicate"], *["_k"] * len(keys))
    counts = df.groupBy(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).agg((F.count("*") > 1).alias("near_duplicate"))
    on = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(counts, on).drop(*names)


def near_duplicate_sample(df: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    return near_duplicate_rows(df, keys).where("near_duplicate").drop("near_duplicate").orderBy(*[F.col(f"`{k}`").asc_nulls_last() for k in [*keys, *[c for c in df.columns if c not in keys]]]).limit(n)


def repeatable_sample(df: DataFrame, rows: int = 5000, seed: int = 42) -> DataFrame:
    """At most ``rows`` rows, the same ones for the same table and seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])).limit(rows)


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Nulls last either way."""
    c = F.col(f"`{column}`")
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def head(df: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order`` if given (nulls last), else as they come."""
    return (df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]) if order else df).limit(n)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows."""
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]).offset(number * size).limit(size)
