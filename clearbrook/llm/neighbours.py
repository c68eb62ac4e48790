"""Approximate nearest neighbours by inner product, with a vantage-point tree for each shard.

Inner products become distances by one more component: with M the largest norm of a shard, x gets sqrt(M^2 - |x|^2) and a query 0, so
that |q - x|^2 = |q|^2 + M^2 - 2 q.x, and the nearest are those with the largest product. A node holds a vantage point and
the median distance to it; by the triangle inequality the far side can be left out when the query's distance differs from the
median by more than that of the worst neighbour held so far. ``factor`` times that distance is what is asked for: 1 is the exact
search, less leaves out more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.shared import load, map_batches, staged

#: Vectors in a shard and queries in a block at most (in the mean, as they are dealt by hash); a task searches one shard for one block.
SHARD_ROWS, BLOCK_ROWS = 1 << 15, 1 << 14
#: Shards are smaller than that where there would be fewer than the session's tasks, but not below this.
SMALL_SHARD = 1 << 13
#: A node of fewer vectors is searched whole.
LEAF = 1 << 10
#: Pruning factor of the query; recall against brute force is in the README.
FACTOR = 0.2
#: Scores within this share of the worst one held are worked out exactly before anything is cut off.
SLACK = 1e-9


class Tree:
    """Vectors of one length, each once, with the ids that have it (ascending) and a vantage-point tree over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(1)
        self.first = np.append(np.flatnonzero(fresh), len(ids))
        self.ids, self.vectors = ids, vectors[fresh].astype(np.float64)
        squares = (self.vectors**2).sum(1)
        self.most = float(squares.max(initial=0))
        self.lift = np.sqrt(np.maximum(0, self.most - squares))
        self.root = self._node(np.arange(len(self.vectors)), np.random.default_rng(len(ids)))

    def _node(self, members: np.ndarray, rng: np.random.Generator) -> tuple:
        if len(members) <= LEAF:
            return (members,)
        vantage = int(rng.choice(members))
        away = np.sqrt(np.maximum(0, ((self.vectors[members] - self.vectors[vantage]) ** 2).sum(1) + (self.lift[members] - self.lift[vantage]) ** 2))
        radius = float(np.median(away))
        inside = away < radius
        if not inside.any():  # more than half lie at one distance
            inside = away <= radius
        if inside.all():
            return (members,)
        return vantage, radius, self._node(members[inside], rng), self._node(members[~inside], rng)

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, place of vector) of all that may be among the k nearest found, with those that are as near."""
        norms = (queries**2).sum(1) + self.most
        best = np.full((len(queries), k), -np.inf)  # the k largest products so far, ascending
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(node: tuple, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 1:
                products = queries[who] @ self.vectors[node[0]].T
                floor = best[who, 0]
                row, column = np.nonzero(products >= (floor - SLACK * (1 + np.abs(floor)))[:, None])
                seen.append((who[row], node[0][column], products[row, column]))
                top = np.concatenate([best[who], products], 1)
                best[who] = np.sort(np.partition(top, top.shape[1] - k, 1)[:, -k:], 1)
                return
            vantage, radius, near, far = node
            away = np.sqrt(np.maximum(0, norms[who] - 2 * (queries[who] @ self.vectors[vantage])))
            inner = away < radius
            visit(near, who[inner])
            visit(far, who[~inner])
            gap = np.abs(away - radius)
            worst = np.sqrt(np.maximum(0, norms[who] - 2 * best[who, 0]))  # infinite until k are held
            over = gap <= factor * worst * (1 + SLACK)
            visit(far, who[inner & over])
            visit(near, who[~inner & over])

        visit(self.root, np.arange(len(queries)))
        who, place, product = (np.concatenate(x) for x in zip(*seen))
        floor = best[who, 0]
        keep = product >= floor - SLACK * (1 + np.abs(floor))
        return who[keep], place[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def sound(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of ``keys``: ids and vectors as bytes."""

    def pack(table: pa.Table) -> pa.Table:
        ids, vectors = table.column("vec_id").to_numpy(), table.column("embedding").combine_chunks()
        data = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return table.select(keys).slice(0, 1).append_column("ids", pa.array([ids.astype(np.int64).tobytes()])).append_column("vectors", pa.array([data.tobytes()]))

    return rows.groupBy(*keys).applyInArrow(pack, ", ".join([*(f"{k} int" for k in keys), "ids binary", "vectors binary"]))


def nearest(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, small_shard: int = SMALL_SHARD) -> DataFrame:
    """For each row of ``df`` where ``queries`` holds its ``k`` nearest other rows: query_id, rank from 1, vec_id, score (inner product in double precision).

    Ties go to the smaller id. With ``factor`` 1 the result is exact, with less some neighbours may be missed. Rows without an id or a sound vector (`sound`)
    take no part; vectors are only compared with those of their length. Rows that share an id count once, with the largest vector. A query with
    fewer than ``k`` others gets all of them; an empty table gives an empty one; other columns are not read.
    """
    spark = df.sparkSession
    taking = df.where(F.col(key).isNotNull() & sound(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = staged(taking.groupBy("vec_id").agg(F.max("embedding").alias("embedding"), F.max("asks").alias("asks")).withColumn("size", F.size("embedding")), "vectors")
    total = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks")).first()
    shards = max(-(-total["all"] // shard_rows), min(spark.sparkContext.defaultParallelism, -(-total["all"] // small_shard)), 1)
    blocks = max(-(-total["asks"] // block_rows), 1)
    index = staged(packed(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), ["size", "shard"]), "vector-shards")
    asked = staged(packed(rows.where("asks").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")), ["size", "block"]), "query-blocks")
    # A stated set of queries meets every shard: one row for each shard and block.
    cells = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    other = asked.withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"}).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = cells.join(other, ["size", "shard", "block"]).select("size", "ids", "vectors", "query_ids", "query_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, *data = (c[row].as_py() for c in batch.columns)
                ids, query_ids = np.frombuffer(data[0], np.int64), np.frombuffer(data[2], np.int64)
                vectors, asking = (np.frombuffer(data[x], np.float64).reshape(-1, size) for x in (1, 3))
                tree = Tree(ids, vectors)
                for at in range(0, len(query_ids), 1024):
                    yield found(tree, query_ids[at : at + 1024], asking[at : at + 1024])

    def found(tree: Tree, query_ids: np.ndarray, asking: np.ndarray) -> pa.RecordBatch:
        who, place = tree.search(asking, k + 1, factor)  # one more, as a query finds itself
        score = products(asking[who], tree.vectors[place])
        order = np.lexsort((tree.ids[tree.first[place]], -score, who))
        who, place, score = who[order], place[order], score[order]
        # Of the ids of one vector the k + 1 smallest can be among the nearest.
        many = np.minimum(np.diff(tree.first)[place], k + 1)
        of = np.repeat(np.arange(len(place)), many)
        ids = tree.ids[tree.first[place][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)]
        who, score = who[of], score[of]
        other = ids != query_ids[who]
        who, score, ids = who[other], score[other], ids[other]
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        who, score, ids = who[rank < k], score[rank < k], ids[rank < k]
        return pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    candidates = map_batches(met, run, "query_id long, vec_id long, score double")
    ranked = candidates.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


OP11_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, max(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda x, y: x + y) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
