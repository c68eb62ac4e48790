"""Two-pass external shuffle of records into shards, with DataFrame functions only.

Pass one scatters whole records by seeded hashes into memory-sized buckets (one shuffle). Pass two runs
Fisher-Yates on each bucket (Spark's ``shuffle`` is the inside-out form) and writes it. A bucket is the only
thing held in memory, so the size of a shard doesn't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearbrook.llm.shared import load, set_aside, staged

#: Raw bytes of a bucket.
BUCKET_BYTES = 8 << 20
#: Buckets that one task shuffles.
TASK_BUCKETS = 8
#: So many bucket offsets (24 bytes each) are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_BUCKETS = 500_000
OUTPUTS = ["size", "shard", "grown_shard", "bucket", "slot"]


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard with the largest hash of key and shard wins, so one more shard only takes rows into itself."""
    if shards == 1:
        return F.lit(0)
    tickets = [F.struct(F.xxhash64(F.lit(seed), F.lit(i), key).alias("h"), F.lit(i).alias("i")) for i in range(shards)]
    return F.greatest(*tickets)["i"]


def shuffle_into_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with size, shard, grown_shard, bucket and slot; slots of a shard are gapless from 0.

    Only key and shard count decide the shard, so rows of an equal key share one; grown_shard is the shard if
    there were one more. Null keys are a key of their own, null texts count as one byte. Which bucket of its
    shard a row goes to depends on key, text and the row's place in the input: equal rows, however many, are dealt
    over all buckets of their shard. The order of rows in a partition of ``df`` must be repeatable, as that of a
    table read from files is. An empty table gives no rows; input columns named like
    an output stay as ``<name>_in``.
    """
    df = set_aside(df, [*OUTPUTS, "_record", "_place"])
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    total = df.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, math.ceil(total / (shards * bucket_bytes)))
    scattered = df.withColumn("_place", F.monotonically_increasing_id()).select(
        shard_of(F.col(key), shards, seed).alias("shard"),
        shard_of(F.col(key), shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col("_place")).alias("_order"),
        size.alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_record"),
    ).withColumn("bucket", F.pmod(F.xxhash64("_order"), F.lit(per_shard)).cast("int"))
    by_order = lambda a, b: F.when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)
    buckets = (
        scattered.repartition(math.ceil(shards * per_shard / TASK_BUCKETS), "shard", "bucket")
        .groupBy("shard", "bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_order", "grown_shard", "size", "_record")), by_order).alias("rows"))
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", F.shuffle("rows", seed).alias("rows"))
        .select("shard", "bucket", F.posexplode("rows").alias("at", "row"))
    )
    written = staged(buckets.select("shard", "bucket", "at", "row.grown_shard", "row.size", "row._record"), "shards")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    if shards * per_shard <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    return written.join(offsets, ["shard", "bucket"]).select("_record.*", "size", "shard", "grown_shard", "bucket", (F.col("_offset") + F.col("at")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=<n>`` for each shard; its files are sorted by slot."""
    sharded.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(load(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
