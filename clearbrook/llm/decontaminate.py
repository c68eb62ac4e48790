"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size. An item of a class keeps its smallest shingle hashes, so many that a text which
contains enough of the item must hold one of them: a MinHash sketch whose length follows from the size class and
the threshold, and that misses nothing. (Banding over signatures of whole texts does: a 30-shingle item in a
text of 20,000 shingles has a Jaccard similarity of about 0.001, which 256 hashes meet one time in four.)
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.shared import load, map_batches, schema_with, set_aside, staged

WORD = re.compile(r"[^\W_]+")
SHINGLE, CONTAINED = 5, 0.8
#: Bytes of benchmark text up to which the items are sent to the tasks: as objects of a Python worker they are about 32 times as large.
BROADCAST_BYTES = 2 << 20
FILTER_BITS = 22
FOLD = np.uint64(0x9E3779B97F4A7C15)
HIT = "array<struct<item_id: bigint, n_shingles: int, n_shared: int>>"
HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_shared", pa.int32())]))


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """XXH64 of words; starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(), 7)
        return h


def shingle_codes(words: list[str], memory: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit code of each shingle, in order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([memory[w] for w in words], dtype=np.uint64)
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * FOLD + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return out


def item_shingles(words: list[str], size: int = SHINGLE) -> tuple[int, set[str]]:
    """The length of an item's shingles and the set of them. An item of fewer than ``size`` words is one shingle of its own length."""
    n = min(size, len(words))
    return n, {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def sketch_of(shingles: set[str], size: int, least: float, memory: WordHashes) -> np.ndarray:
    """The smallest hashes of an item's shingles, so many that a text with the share ``least`` of the item must hold one. All sizes of a class (up to the next power of two) take as many as its largest needs."""
    codes = np.unique(np.concatenate([shingle_codes(s.split(" "), memory, size) for s in shingles]))
    largest = 1 << (len(shingles) - 1).bit_length()
    return codes[: largest - math.ceil(least * largest - 1e-9) + 1]


def contained(shingles: set[str], windows: set[str], least: float) -> int | None:
    """How many of the item's shingles the text has, if they are enough."""
    shared = len(shingles & windows)
    return shared if shared >= least * len(shingles) - 1e-9 else None


def windows_of(words: list[str], size: int) -> set[str]:
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


@dataclass
class Sketches:
    """Items by the length of their shingles, and by each hash of their sketches."""

    size: int
    least: float
    items: list[tuple[int | None, int, frozenset[str]]] = field(default_factory=list)
    by_hash: dict[int, dict[int, list[int]]] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)

    def add(self, item_id: int | None, text: str | None, memory: WordHashes) -> None:
        n, shingles = item_shingles(words_of(text), self.size)
        if not shingles:
            return
        table = self.tables.setdefault(n, np.zeros(1 << FILTER_BITS, dtype=bool))
        codes, held = sketch_of(shingles, n, self.least, memory), self.by_hash.setdefault(n, defaultdict(list))
        for code in codes.tolist():
            held[code].append(len(self.items))
        table[codes >> np.uint64(64 - FILTER_BITS)] = True
        self.items.append((item_id, n, frozenset(shingles)))

    def search(self, text: str | None, memory: WordHashes) -> list[dict]:
        """Items of which the share ``least`` or more of the shingles is in the text, by item_id."""
        words, found = words_of(text), []
        for n, table in self.tables.items():
            if len(words) < n:
                continue
            codes = shingle_codes(words, memory, n)
            probed = codes[table[codes >> np.uint64(64 - FILTER_BITS)]]
            candidates = {i for c in set(probed.tolist()) for i in self.by_hash[n].get(c, ())}
            windows = windows_of(words, n) if candidates else set()
            for item_id, _, shingles in (self.items[i] for i in candidates):
                if (shared := contained(shingles, windows, self.least)) is not None:
                    found.append({"item_id": item_id, "n_shingles": len(shingles), "n_shared": shared})
        return sorted(found, key=_by_id)


def _by_id(x: dict) -> tuple:
    return x["item_id"] is None, x["item_id"] or 0, x["n_shingles"], x["n_shared"]


def find_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SHINGLE, least: float = CONTAINED, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with ``items``: item_id, n_shingles and n_shared of every benchmark item that the whole text contains.

    An item is contained if the share ``least`` or more of its distinct ``size``-word shingles is in the text.
    Words are lower-cased runs of letters and digits, so case and punctuation don't matter. An item of fewer
    words is one shingle, and contained where the text has these words in a row. Null or empty items and texts contain and
    match nothing; repeated items and rows each count; an empty table gives an empty one. A benchmark of up to
    ``most_bytes`` of text is sent to the tasks; a larger one is joined to the texts by hash. An input column ``items`` stays as ``items_in``.
    """
    docs = set_aside(docs, ["items"])
    text = text if text in docs.columns else f"{text}_in"
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most_bytes:
        return _joined(docs, items, text, size, least)
    memory, sketches = WordHashes(), Sketches(size, least)
    for row in items.collect():
        sketches.add(row["item_id"], row["text"], memory)
    return _searched(docs, sketches, text)


def _searched(docs: DataFrame, sketches: Sketches, text: str) -> DataFrame:
    sent, at = docs.sparkSession.sparkContext.broadcast(sketches), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, memory = sent.value, WordHashes()
        for batch in batches:
            hits = pa.array([sketches.search(t.as_py(), memory) for t in batch.column(at)], HIT_TYPE)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*batch.schema.names, "items"])

    return map_batches(docs, run, schema_with(docs, f"items {HIT}"))


def _joined(docs: DataFrame, items: DataFrame, text: str, size: int, least: float) -> DataFrame:
    """The same by joins: sketch hashes of the items to the hashes of all windows of the texts, then each candidate to both texts."""
    docs = set_aside(docs, ["_row", "_text", "_hits"])
    text = text if text in docs.columns else f"{text}_in"
    docs = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "searched-texts")
    items = staged(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, shingles = item_shingles(words_of(t), size)
                if shingles:
                    codes = sketch_of(shingles, n, least, memory)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), n, dtype=np.int32)), pa.array(codes.view(np.int64)), pa.array(np.full(len(codes), item))], ["n", "code", "item"])

    sketches = staged(map_batches(items.select("item", "text"), sketch, "n int, code long, item long"), "item-sketches")
    sizes = sorted(r["n"] for r in sketches.select("n").distinct().collect())

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                for n in sizes:
                    codes = np.unique(shingle_codes(words, memory, n)) if len(words) >= n else np.zeros(0, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), n, dtype=np.int32)), pa.array(codes.view(np.int64)), pa.array(np.full(len(codes), row))], ["n", "code", "_row"])

    codes = map_batches(docs.select("_row", text), windows, "n int, code long, _row long")
    pairs = staged(codes.join(sketches, ["n", "code"]).select("_row", "item").distinct(), "candidates")
    both = pairs.join(docs.select("_row", F.col(text).alias("text")), "_row").join(items.select("item", "item_id", F.col("text").alias("of_item")), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, item_id, t, of_item in zip(*[batch.column(c) for c in ("_row", "item_id", "text", "of_item")], strict=True):
                n, shingles = item_shingles(words_of(of_item.as_py()), size)
                shared = contained(shingles, windows_of(words_of(t.as_py()), n), least)
                if shared is not None:
                    found.append({"_row": row.as_py(), "item_id": item_id.as_py(), "n_shingles": len(shingles), "n_shared": shared})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("_row", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_shared", pa.int32())]))

    hits = map_batches(both.select("_row", "item_id", "text", "of_item"), verify, "_row long, item_id long, n_shingles int, n_shared int")
    by_row = hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.col("item_id").isNull().alias("last"), "item_id", "n_shingles", "n_shared"))).alias("_hits"))
    listed = F.transform("_hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["n_shingles"].alias("n_shingles"), h["n_shared"].alias("n_shared")))
    return docs.join(by_row, "_row", "left").withColumn("items", F.coalesce(listed, F.expr(f"cast(array() as {HIT})"))).drop("_row", "_hits")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contaminated(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    hits = found.select("doc_id", F.explode("items").alias("x"))
    return hits.select("doc_id", "x.item_id", "x.n_shingles", "x.n_shared", (F.col("x.n_shared") / F.col("x.n_shingles")).alias("containment"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bn AS (SELECT i, item_id, w, least(len(w), 5) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT i, item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT i, item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM bn)),
sizes AS (SELECT DISTINCT n FROM bn),
ds AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT r, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
t AS (SELECT i, count(*) AS n_shingles FROM bs GROUP BY i),
c AS (SELECT r, doc_id, i, item_id, count(*) AS n_shared FROM ds JOIN bs USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(n_shared AS INTEGER) AS n_shared, n_shared / n_shingles AS containment
FROM c JOIN t USING (i) WHERE n_shared >= 0.8 * n_shingles
"""
