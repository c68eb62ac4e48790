"""SimHash fingerprints and near duplicates by the generalised pigeonhole principle.

Fingerprints within ``tau`` bits agree, for any split of their bits into m parts with thresholds that add up to
tau - m + 1, within the threshold of some part. Bits that go together are put in one part, so that skew stays
there, and thresholds (-1: the part isn't probed) are chosen by dynamic programming on estimated candidate
counts. Part values are shuffle keys: the rows of a key are probed and verified in runs of bounded size, a
longer run is dealt out again by the bits its rows don't share yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.components import components
from clearbrook.llm.shared import load, map_batches, schema_with, set_aside, staged

#: Longest run of one key that a task compares within itself; every longer one is split by more bits.
RUN = 2048
#: Comparing two fingerprints costs so much less than shuffling one key.
PAIRS_PER_KEY = 200
#: Nodes (about 100 bytes each) that are broadcast to the texts at most; more are joined by shuffle.
BROADCAST_NODES = 200_000
#: Texts that frequent shingles are looked for in at most, and the share of them that makes one frequent. They only order shingles; no result depends on them.
SAMPLED, FREQUENT = 20_000, 0.001
#: Neighbours in a run of one shingle that are compared before all pairs still apart are: a large group is mostly joined by the first.
REACHES = (8, None)
#: Least and largest number of bits of a parity sketch, which has four for each shingle in between.
SKETCH_BITS = (256, 4096)
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all ``size``-word shingles in order, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
    if size == 1:
        return np.fromiter((digest(w, 42) for w in words), dtype=np.uint64, count=len(words))
    whole, ends, p = b" ".join(words), [], -1
    for w in words:
        p += len(w) + 1
        ends.append(p)
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return np.array([digest(whole[a:b], 42) for a, b in zip(starts, ends[size - 1 :], strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: str | None, size: int, prints: int, distinct: bool) -> list[int]:
    """``prints`` fingerprints of a text: the first of the shingle hashes themselves, others of the hashes mixed anew. ``distinct`` counts a shingle once."""
    h = shingle_hashes(text, size)
    h = np.unique(h) if distinct else h
    out = [majority(h)]
    for k in range(1, prints):
        x = h + np.uint64(k * int(MIX[2]) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def with_fingerprints(df: DataFrame, text: str = "text", size: int = 3, prints: int = 1, distinct: bool = False) -> DataFrame:
    """``df`` without ``text`` but with fps (array of ``prints`` longs). Null and empty texts have fingerprint 0."""
    rest = set_aside(df, ["fps"])
    text = text if text in rest.columns else f"{text}_in"
    at, kept = rest.columns.index(text), [i for i, c in enumerate(rest.columns) if c != text]
    rest_schema = schema_with(rest.drop(text), "fps array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(fingerprints(t.as_py(), size, prints, distinct), dtype=np.uint64).view(np.int64) for t in batch.column(at)]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            fps = pa.ListArray.from_arrays(pa.array(np.arange(0, prints * batch.num_rows + 1, prints, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], fps], [*[batch.schema.names[i] for i in kept], "fps"])

    return map_batches(rest, run, rest_schema)


# -- the plan: parts and thresholds ------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By print number k: (rows, for each pair of bits the rows that have both). 64 x 64 numbers for each k, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 65536):
                k = batch.column(0)[i : i + 65536].to_numpy()
                bits = np.unpackbits(batch.column(1)[i : i + 65536].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                for x in np.unique(k):
                    own = bits[k == x]
                    sums = both.setdefault(int(x), np.zeros(4097, dtype=np.int64))
                    sums[:4096] += (own.T @ own).astype(np.int64).ravel()
                    sums[4096] += len(own)
        for x, sums in both.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(4097, x, dtype=np.int32)), pa.array(np.arange(4097, dtype=np.int32)), pa.array(sums)], ["k", "at", "n"])

    found: dict[int, np.ndarray] = {}
    for r in map_batches(fps.select(F.col("k").cast("int"), "fp"), run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r["k"], np.zeros(4097))[r["at"]] = r["n"]
    return {k: (int(x[4096]), x[:4096].reshape(64, 64)) for k, x in found.items()}


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of near equal size: each starts with the most one-sided bit left and takes in turn the bit that correlates most with it."""
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(64)), []
    for k in range(parts):
        group = [min(left, key=lambda i: (spread[i], i))]
        left.discard(group[0])
        for _ in range((len(left) + 1) // (parts - k) - 1 + bool((len(left) + 1) % (parts - k))):
            best = max(left, key=lambda i: (tied[i, group].sum(), -i))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def agreement(n: int, both: np.ndarray, group: list[int]) -> list[float]:
    """Estimated share of pairs of rows that agree on all bits of a group, and on all but one at most: a chain of pairwise agreements."""
    p = both / max(1, n)
    single = lambda i: p[i, i] ** 2 + (1 - p[i, i]) ** 2

    def pair(i: int, j: int) -> float:
        a = p[i, j]
        cells = a, p[i, i] - a, p[j, j] - a, 1 - p[i, i] - p[j, j] + a
        return sum(max(0.0, c) ** 2 for c in cells)

    same, q = single(group[0]), [single(group[0])]
    for i, j in zip(group, group[1:], strict=False):
        q.append(min(1.0, pair(i, j) / max(single(i), 1e-9)))
        same *= q[-1]
    return [same, same * (1 + sum((1 - x) / max(x, 1e-9) for x in q))]


def plan_parts(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed, at the least estimated cost over all numbers of parts."""
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, tau + 2):
        groups = grouped_bits(n, both, m)
        shares = [agreement(n, both, g) for g in groups]
        keys = lambda g, t: sum(math.comb(len(g), k) for k in range(t + 1))
        # cost[s]: least cost of the parts so far with thresholds that add up to s
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for g, share in zip(groups, shares, strict=True):
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in cost.items():
                for t in (-1, 0, 1, 2) if m == 1 else (-1, 0, 1):
                    pairs = 0 if t < 0 else n * n / 2 * (share[min(t, 1)] * (len(g) if t > 1 else 1))
                    new = c + n * keys(g, t) * PAIRS_PER_KEY + pairs
                    if new < step.get(s + t, (math.inf,))[0]:
                        step[s + t] = (new, [*chosen, t])
            cost = step
        found = cost.get(tau - m + 1)
        if found and found[0] < best[0]:
            best = (found[0], [(g, t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


# -- probing and verifying -----------------------------------------------------------------------------------


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    x = np.zeros(1, dtype=np.uint64)
    for p in parts:
        x = (np.asarray(p, dtype=np.uint64) ^ x) + MIX[2]
        x = (x ^ (x >> np.uint64(30))) * MIX[0]
        x = (x ^ (x >> np.uint64(27))) * MIX[1]
        x = x ^ (x >> np.uint64(31))
    return x


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _keys(fp: DataFrame, plans: dict[int, list[tuple[list[int], int]]]) -> DataFrame:
    """(key, fp, node, free): a row for each part value within the part's threshold; free: the bits outside the part. Each print number has its own plan and keys."""
    node = fp.schema["node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("k").to_numpy()
            for x in np.unique(prints).tolist():
                rows = batch.filter(pa.array(prints == x))
                f = _column(rows, "fp")
                for part, (bits, t) in enumerate(plans[x]):
                    own = _mask(bits)
                    for n in range(t + 1):
                        for flipped in combinations(bits, n):
                            key = _mixed(x * 64 + part, (f & own) ^ _mask(list(flipped)))
                            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rows.column("fp"), rows.column("node"), pa.array(np.full(len(f), ~own).view(np.int64))], ["key", "fp", "node", "free"])

    return map_batches(fp.select(F.col("k").cast("int"), "fp", "node"), run, f"key long, fp long, node {node.dataType.simpleString()}, free long")


def _split(rows: DataFrame, tau: int) -> DataFrame:
    """Rows of too long runs under longer keys: the free bits in tau + 1 chunks, of which two rows within tau bits share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, f, free = (_column(batch, c) for c in ("key", "fp", "free"))
            for mask in np.unique(free):
                at = np.flatnonzero(free == mask)
                bits = [b for b in range(64) if int(mask) >> b & 1]
                for k in range(tau + 1):
                    own = _mask(bits[k :: tau + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(key[at], k, f[at] & own).view(np.int64)), batch.column("fp").take(pa.array(at)), batch.column("node").take(pa.array(at)), pa.array(np.full(len(at), mask & ~own).view(np.int64))], ["key", "fp", "node", "free"])

    return map_batches(rows.select("key", "fp", "node", "free"), run, rows.select("key", "fp", "node", "free").schema)


def _runs(batches: Iterator[pa.RecordBatch], longest: int, tau: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Whole runs of equal keys (sorted by key), many at a time; (True, rows) for rows of a run that is longer than ``longest`` and can be split.

    Fingerprints of a run that has no more than ``tau`` free bits left differ in those and in the few flipped bits
    only: there are at most a few thousand different ones, so such a run is held whole.
    """

    def cut(rows: pa.RecordBatch) -> Iterator[tuple[bool, pa.RecordBatch]]:
        key, free = _column(rows, "key"), _column(rows, "free")
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        long = np.flatnonzero((np.diff(starts) > longest) & (np.bitwise_count(free[starts[:-1]]) > tau))
        at = 0
        for r in long:
            if starts[r] > at:
                yield False, rows.slice(at, starts[r] - at)
            yield True, rows.slice(starts[r], starts[r + 1] - starts[r])
            at = starts[r + 1]
        if at < len(key):
            yield False, rows.slice(at)

    held: list[pa.RecordBatch] = []  # rows of the last key, whose run may go on
    hot = None  # the key of a run that is known to be too long
    for batch in batches:
        if not batch.num_rows:
            continue
        key = _column(batch, "key")
        if hot is not None:
            n = len(key) if (key == hot).all() else int(np.argmax(key != hot))
            if n:
                yield True, batch.slice(0, n)
            batch, key = batch.slice(n), key[n:]
            if not len(key):
                continue
            hot = None
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            key, held = _column(batch, "key"), []
        last = int(np.argmax(key == key[-1]))  # sorted: the first row of the last key
        if last:
            yield from cut(batch.slice(0, last))
        if len(key) - last > longest and int(_column(batch, "free")[-1]).bit_count() > tau:
            hot = key[-1]
            yield True, batch.slice(last)
        else:
            held = [batch.slice(last)]
    for rows in held:
        yield from cut(rows)


def _links(key: np.ndarray, f: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one key whose fingerprints differ in tau bits at most."""
    at, d = np.arange(len(key)), 0
    while True:
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return
        near = at[np.bitwise_count(f[at] ^ f[at + d]) <= tau]
        if len(near):
            yield near, near + d


def _probe(rows: DataFrame, tau: int, longest: int) -> DataFrame:
    """Links as a forest for each key (kind 0: a and b), and rows of runs that are too long (kind 1: group, a, fp, free). Links between rows of one tree add nothing and are left out."""
    node = pa.string() if rows.schema["node"].dataType.simpleString() == "string" else pa.int64()
    names = ["kind", "group", "a", "b", "fp", "free"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, batch in _runs(batches, longest, tau):
            key, f, nodes, n = _column(batch, "key"), _column(batch, "fp"), batch.column("node"), batch.num_rows
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, dtype=np.int32)), batch.column("key"), nodes, pa.nulls(n, node), batch.column("fp"), batch.column("free")], names)
                continue
            up: dict[int, int] = {}

            def root(i: int, up: dict[int, int] = up) -> int:
                while (p := up.get(i, i)) != i:
                    up[i] = i = up.get(p, p)
                return i

            first, second = [], []
            for i, j in _links(key, f, tau):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        up[max(rx, ry)] = min(rx, ry)
                        first.append(x)
                        second.append(y)
            if first:
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), pa.array(key[first].view(np.int64)), nodes.take(pa.array(first)), nodes.take(pa.array(second)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

    kind = rows.schema["node"].dataType.simpleString()
    return map_batches(rows.repartition("key").sortWithinPartitions("key"), run, f"kind int, `group` long, a {kind}, b {kind}, fp long, free long")


def near_links(fp: DataFrame, tau: int, longest: int = RUN) -> DataFrame:
    """(a, b) edges between nodes of ``fp`` (node, fp and, if there are several prints, its number k; the fingerprints of a k are distinct) that join all nodes within ``tau`` bits of each other, directly or through others."""
    fp = fp if "k" in fp.columns else fp.withColumn("k", F.lit(0))
    rows, edges = _keys(fp, {k: plan_parts(n, both, tau) for k, (n, both) in bit_counts(fp).items()}), None
    while True:
        found = staged(_probe(rows, tau, longest), "probed")
        new = found.where("kind = 0").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        long = found.where("kind = 1").select(F.col("group").alias("key"), "fp", F.col("a").alias("node"), "free")
        if long.isEmpty():
            return edges
        rows = _split(long, tau)


def hamming_components(docs: DataFrame, key: str = "doc_id", text: str = "text", tau: int = 2, size: int = 3) -> DataFrame:
    """(key, fingerprint as hex, component_id) of each row: components of fingerprints that link at ``tau`` or fewer bits.

    component_id is the smallest key of the component; null keys don't count unless there is no other. Rows of
    one fingerprint are one node, so copies cost nothing. Null and empty texts have fingerprint zero and link like others.
    """
    prints = staged(with_fingerprints(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", size).select("doc_id", F.col("fps")[0].alias("fp")), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = components(near_links(nodes.select("fp", F.col("fp").alias("node")), tau))
    held = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = held.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = held.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_components(load(spark, sf_dir, "documents"))


#: Columns that ``near_duplicates`` adds or uses.
NEAR_OUTPUTS = ["group_id", "keep", "repeated", "_node", "_first"]

# -- near-duplicate groups by shingle similarity ---------------------------------------------------------------


def _shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, node, shingles): the sorted set of each text's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                sets = [np.unique(shingle_hashes(t.as_py(), size)).astype("<u8").tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), pa.array(sets, pa.binary())], ["id", "node", "shingles"])

    return map_batches(texts.select("id", "node", "text"), run, "id long, node string, shingles binary")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs`` (ids a and b) with the digests x and y of their texts and ``alike``: whether the Jaccard similarity of their shingle sets is ``least`` or more."""
    both = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("node").alias("x"), F.col("shingles").alias("_sx")), "a").join(sets.select(F.col("id").alias("b"), F.col("node").alias("y"), F.col("shingles").alias("_sy")), "b")
    names = ["a", "b", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("_sx"), batch.column("_sy"), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(alike, pa.bool_())], [*names, "alike"])

    return map_batches(both, run, schema_with(both.select(*names), "alike boolean"))


def _id(node: str) -> Column:
    """60 bits of a text digest: of texts that share them, each is tested."""
    return F.conv(F.substring(node, 1, 15), 16, 10).cast("long")


def _one_of_each(texts: DataFrame) -> DataFrame:
    """A row for each node; only texts that occur again are shuffled."""
    again = _small(staged(texts.groupBy("node").count().where("count > 1").select("node"), "repeated-texts"))
    return texts.join(again, "node", "left_anti").unionByName(texts.join(again, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))


def _frequent_shingles(texts: DataFrame, size: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Frequent shingles in order, and their counts, over a sample of about ``SAMPLED`` of ``n`` texts; and how many texts one of the sample stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                sets = [np.unique(shingle_hashes(t.as_py(), size)) for t in batch.column(0)[k : k + 200]]
                shingles, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(counts)], ["shingle", "n"])

    part = texts if n <= SAMPLED else texts.where(F.pmod(F.xxhash64("node"), F.lit(n)) < SAMPLED)
    often = map_batches(part.select("text"), run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= max(20, FREQUENT * min(n, SAMPLED))).toArrow()
    shingles, counts = often.column("shingle").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order], max(1.0, n / SAMPLED)


def _prefix_keys(texts: DataFrame, size: int, least: float, often: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(key, id, size, at, deal): the first shingles of each set in one order, rare ones first, so many that two sets with a similarity of ``least`` share one of them.

    deal: -1, but for keys known as frequent a number that spreads their rows over several tasks.
    """
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, times = sent.value
        deals = np.ceil(counts * times / RUN).astype(np.int64)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for k in range(0, batch.num_rows, 200):
                keys, sizes, dealt = [], [], []
                for i, t in zip(ids[k : k + 200].tolist(), batch.column("text")[k : k + 200], strict=True):
                    h = np.unique(shingle_hashes(t.as_py(), size))
                    sizes.append(len(h))
                    n = len(h) - math.ceil(least * len(h) - 1e-9) + 1 if len(h) else 0
                    deal = np.full(n, -1, dtype=np.int64)
                    if n and len(frequent):
                        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                        known = frequent[at] == h
                        order = np.lexsort((h, np.where(known, counts[at], 0)))[:n]
                        h, known, at = h[order], known[order], at[order]
                        deal[known] = i % deals[at[known]]
                    keys.append(h[:n])
                    dealt.append(deal)
                n = [len(x) for x in keys]
                at = np.concatenate([np.arange(x, dtype=np.int32) for x in n])
                columns = np.concatenate(keys).view(np.int64), np.repeat(ids[k : k + 200], n), np.repeat(np.array(sizes, dtype=np.int32), n), at, np.concatenate(dealt)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "size", "at", "deal"])

    return map_batches(texts.select("id", "text"), run, "key long, id long, size int, at int, deal long")


def _shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, size, at) of keys that more than one row has. A stream of sorted rows, of which one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row so far, and whether it equals the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = _column(rows, "key")
            same = key[1:] == key[:-1]
            keep = np.concatenate(([met], same)) | np.concatenate((same, [False])) | (rows.column("deal").to_numpy() >= 0)
            yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
            held, met = rows.slice(len(key) - 1), bool(same[-1]) if len(same) else met
        if held is not None and (met or held.column("deal")[0].as_py() >= 0):
            yield held

    return map_batches(keys.repartition("key", "deal").sortWithinPartitions("key", "deal"), run, keys.schema).drop("deal")


def parity_sketch(shingles: np.ndarray) -> bytes:
    """A bit is 1 if an odd number of the set's hashes fall on it. Two sets differ in at least as many elements as their sketches in bits."""
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << max(0, 4 * len(shingles) - 1).bit_length()))
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [parity_sketch(np.unique(shingle_hashes(t.as_py(), size))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sketches, pa.binary())], ["id", "sketch"])

    return map_batches(texts.select("id", "text"), run, "id long, sketch binary")


class SketchTable:
    """The sketches of some rows, by width; a wider one is folded to the width of a narrower one before they are compared."""

    def __init__(self, sketches: pa.Array) -> None:
        values, self.of = sketches.to_pylist(), {}
        self.width = np.array([len(x) for x in values])
        for w in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            table = np.frombuffer(b"".join(values[i] for i in own), dtype=np.uint64).reshape(-1, w // 8)
            if len(wider):
                halves = np.frombuffer(b"".join(values[i] for i in wider), dtype=np.uint64).reshape(-1, 2, w // 8)
                table = np.concatenate((table, halves[:, 0] ^ halves[:, 1]))
            at = np.full(len(values), -1)
            at[np.concatenate((own, wider))] = np.arange(len(table))
            self.of[w] = (table, at)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of rows x and y differ; 0 where one is over twice as wide."""
        out = np.zeros(len(x), dtype=np.int64)
        least = np.minimum(self.width[x], self.width[y])
        for w, (table, at) in self.of.items():
            here = np.flatnonzero((least == w) & (at[x] >= 0) & (at[y] >= 0))
            for k in range(0, len(here), 20_000):
                part = here[k : k + 20_000]
                out[part] = np.bitwise_count(table[at[x[part]]] ^ table[at[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _prefix_pairs(rows: DataFrame, least: float, reach: int | None) -> DataFrame:
    """(a, b): ids of one key (of at most ``reach`` rows apart, by size) with different roots whose sizes, places of the key and sketches allow a similarity of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _runs(batches, 1 << 62, 64):
            key, root = _column(part, "key"), _column(part, "root")
            ids, size, at, side = (part.column(c).to_numpy() for c in ("id", "size", "at", "side"))
            sketches, here, d = None, np.arange(len(key)), 0
            while len(here) and d != reach:
                d += 1
                here = here[here + d < len(key)]
                # In order of size: one that is too long for a row is followed by longer ones.
                here = here[(key[here] == key[here + d]) & (size[here] >= least * size[here + d] - 1e-9)]
                there = here + d
                both = size[here] + size[there]
                most = np.minimum(size[here] - at[here], size[there] - at[there])  # if this key is the first that they share
                near = (root[here] != root[there]) & ((side[here] == 0) | (side[here] != side[there])) & (most >= least / (1 + least) * both - 1e-9)
                if near.any():
                    sketches = sketches or SketchTable(part.column("sketch"))
                    x, y = here[near], there[near]
                    x, y = (z[sketches.differ(x, y) <= (1 - least) / (1 + least) * both[near] + 1e-9] for z in (x, y))
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    return map_batches(rows.repartition("key").sortWithinPartitions("key", "size", "id"), run, "a long, b long").distinct()


def _mixed_keys(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, size, at, root, n) of keys whose rows have different roots; n: rows of the key."""
    rooted = rows.join(_small(roots), "id", "left").select("key", "id", "size", "at", F.coalesce("root", "id").alias("root"))
    keys = staged(rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("n")).where("_a <> _b").select("key", "n"), "mixed-keys")
    return staged(rooted.join(_small(keys), "key"), "mixed-rows")


def _in_blocks(rows: DataFrame, longest: int) -> DataFrame:
    """The rows of a key of more than ``longest`` rows dealt out, and each deal met with each other one under a key of their own. side: 1 and 2 for the two deals of such a key, else 0."""
    deals = F.ceil(F.col("n") / longest).cast("int")
    own = F.pmod(F.xxhash64("id"), deals).cast("int")
    met = F.transform(F.sequence(F.lit(0), deals - 1), lambda d: F.struct(F.least(own, d).alias("i"), F.greatest(own, d).alias("j"), F.when(d == own, 0).when(own < d, 1).otherwise(2).alias("side")))
    placed = rows.where(F.col("n") > longest).select("*", F.explode(met).alias("m")).select(F.xxhash64("key", "m.i", "m.j").alias("key"), "id", "size", "at", "root", "m.side")
    return rows.where(F.col("n") <= longest).select("key", "id", "size", "at", "root", F.lit(0).alias("side")).unionByName(placed)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, least: float = 0.8, prints: int = 4, tau: int = 5, longest: int = RUN) -> DataFrame:
    """``docs`` with group_id, keep and repeated: groups of near duplicates, of which the row with the smallest key stays.

    Two texts are alike if the sets of their ``size``-word shingles have a Jaccard similarity of ``least`` or
    more. Most are found by ``prints`` fingerprints over distinct words that differ in ``tau`` bits at most
    (``near_links``). That can miss copies that gained or lost a block, so all texts that are still apart and share
    one of their rarest shingles, as every two alike do, are compared as well inside the tasks, by bounds that no pair
    alike fails: no pair is missed. Each candidate is verified on the shingles. group_id is a hash of the group's
    smallest text digest. Equal texts are one candidate, whatever their number. Null and empty texts are alike among
    themselves; very long ones are compared whole; an empty table gives none. Of rows of one text and key
    that come first all are marked to stay, and as repeated; null keys come last. Input columns named like an output stay as ``<name>_in``.
    """
    docs = set_aside(docs, NEAR_OUTPUTS)
    text = text if text in docs.columns else f"{text}_in"
    key = key if key in docs.columns else f"{key}_in"
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    texts = docs.select(digest.alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    single = staged(_one_of_each(texts).select("node", _id("node").alias("id"), "text"), "texts")
    marked = with_fingerprints(single.select("id", "text"), "text", 1, prints, True).select("id", F.posexplode("fps").alias("k", "fp"))
    marked = staged(marked, "fingerprints")
    firsts = staged(marked.groupBy("k", "fp").agg(F.min("id").alias("node"), F.count("*").alias("n")), "fingerprint-nodes")
    equal = marked.join(_small(staged(firsts.where("n > 1").drop("n"), "equal-fingerprints")), ["k", "fp"]).where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = near_links(firsts.drop("n"), tau, longest).unionByName(equal)
    tested = roots = None

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All pairs tested so far and the components of those alike."""
        pairs = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        ends = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
        sets = staged(_shingle_sets(single.join(_small(ends), "id", "left_semi"), size), "shingle-sets")
        now = staged(_alike(pairs, sets, least), "tested")
        now = now if tested is None else tested.unionByName(now)
        return now, staged(components(now.where("alike").select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")

    tested, roots = verified(found)
    # Fingerprints miss pairs, and forests of them leave some out: every pair still apart that can be alike shares a key.
    often = _frequent_shingles(single, size, single.count())
    rows, sketches = staged(_shared_keys(_prefix_keys(single, size, least, often)), "shared-keys"), None
    for reach in REACHES:
        rows = _mixed_keys(rows.select("key", "id", "size", "at"), roots.select(_id("node").alias("id"), _id("root").alias("root")))
        if sketches is None:
            sketches = staged(_sketches(single.join(_small(staged(rows.select("id").distinct(), "met")), "id", "left_semi"), size), "sketches")
        met = _in_blocks(rows, longest).join(sketches, "id").withColumn("free", F.lit(-1).cast("long"))
        pairs = staged(_prefix_pairs(met, least, reach).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "prefix-pairs")
        if not pairs.isEmpty():
            tested, roots = verified(pairs)
    rank = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_node").alias("node"), F.col("rows"))
    firsts = docs.select(F.col(key), digest.alias("_node")).groupBy("_node", F.col(key)).agg(F.count("*").alias("rows"))
    firsts = firsts.groupBy("_node").agg(F.min(rank).alias("_first"), F.sum("rows").alias("_rows")).join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    # A text of one row that is like no other needs no verdict.
    firsts = staged(firsts.where("root is not null or _rows > 1").select("_node", F.coalesce("root", "_node").alias("group_id"), "_first"), "firsts")
    winners = firsts.groupBy("group_id").agg(F.min("_first").alias("_first"))
    verdicts = staged(firsts.select("_node", "group_id").join(winners, "group_id"), "verdicts")
    placed = docs.withColumn("_node", digest).join(_small(verdicts), "_node", "left").withColumn("group_id", F.coalesce("group_id", "_node"))
    first = F.col("_first.node").isNull() | ((F.col("_node") == F.col("_first.node")) & F.col(key).eqNullSafe(F.col("_first.k")))
    return placed.withColumns({"keep": first, "repeated": F.coalesce(F.col("_first.rows") > 1, F.lit(False)) & first}).drop("_node", "_first")


def _small(df: DataFrame) -> DataFrame:
    """A staged table as one to broadcast, if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def first_of_each_group(docs: DataFrame, **options: object) -> DataFrame:
    """One row of each group of ``near_duplicates``. Only if equal rows come first in some group are rows dealt by group once more."""
    marked = near_duplicates(docs, **options)
    kept = marked.where("keep").drop("keep")
    if not marked.where("repeated").isEmpty():
        kept = kept.where("not repeated").unionByName(kept.where("repeated").dropDuplicates(["group_id"]))
    return kept.drop("group_id", "repeated")
