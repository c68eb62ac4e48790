"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words and over word beginnings that occur once, twice or four times at least. Every labelled text that names a group is also read with
the names swapped within their kind, and the loss adds the squared change of the score: what only tells groups
apart gets no weight, so that neutral mentions are no reason for rejection.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.shared import held_out, load, map_batches, schema_with, set_aside, staged

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that the classifier is fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 30_000
FIT_TASKS = 48
#: Features kept: seen in MIN_ROWS fitted texts or more, those that tell the classes apart best.
FEATURES, MIN_ROWS = 1_000, 8
#: Texts whose features a worker counts at once.
CHUNK = 100
#: Words whose features a worker remembers.
REMEMBERED = 60_000
STARTS, TIMES = (4, 5, 6, 7), (1, 2, 4)
REJECT = 0.7
#: Names of groups by kind; a name is swapped for the next one of its list.
IDENTITY_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["female", "male"], ["she", "he"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["gay", "straight", "lesbian", "bisexual"], ["transgender", "cisgender"], ["black", "white", "asian", "latino"],
    ["africans", "europeans", "asians", "americans"], ["african", "european", "american"], ["immigrants", "natives"], ["refugees", "citizens"],
    ["elderly", "young"], ["disabled", "abled"], ["blind", "sighted"], ["deaf", "hearing"],
    ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden"], ["ausländer", "inländer"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulmans", "chrétiens", "juifs"], ["étrangers", "français"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmanes", "cristianos", "judíos"], ["extranjeros", "españoles"],
]


def swaps(terms: list[list[str]]) -> dict[str, str]:
    return {a: b for kind in terms for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}


def parts_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked with ``^``."""
    return [word, *[f"^{word[:n]}" for n in STARTS if len(word) >= n]]


class Parts(dict):
    """``parts_of`` words that a worker has met; starts anew when it is full."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = parts_of(word)
        return found


def text_features(words: Counter, memory: Parts) -> set[str]:
    """Words of a text, and beginnings with the times (of TIMES) that they occur at least."""
    starts: dict[str, int] = {}
    for w, k in words.items():
        for s in memory[w][1:]:
            starts[s] = starts.get(s, 0) + k
    out = {*words, *[f"{s}|1" for s in starts]}
    out.update(f"{s}|{t}" for s, k in starts.items() if k > 1 for t in TIMES[1:] if k >= t)
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        #: Beginnings that some feature counts, under the mark of the lowest count.
        self.parts = {f"{f.rpartition('|')[0]}|{TIMES[0]}" for f in self.weights if f[0] == "^"}

    def score(self, text: str | None, memory: dict[str, tuple[str, ...]]) -> float:
        """Probability of label 1. A text without known parts gets that of the bias."""
        found: Counter = Counter()
        for w, k in Counter(WORD.findall(text.lower())).items() if text else ():
            known = memory.get(w)
            if known is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                known = memory[w] = tuple(p for p in parts_of(w) if p in self.weights or f"{p}|{TIMES[0]}" in self.parts)
            for p in known:
                found[p] += k
        used = [f for p, k in found.items() for f in ([f"{p}|{t}" for t in TIMES if k >= t] if p[0] == "^" else [p])]
        z = self.bias + math.fsum(self.weights.get(f, 0.0) for f in used)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents. Labels are joined by doc_id; of several labels of one id the highest holds, of several texts the first by order."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row for each id, over a fixed number of tasks: they are few rows, but much to count.
    return found.repartition(FIT_TASKS, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def train(labelled: DataFrame, terms: list[list[str]] | None = None, strength: float = 1.0, keep: int = FEATURES, min_rows: int = MIN_ROWS, ridge: float = 1e-3, steps: int = 300) -> ToxicityModel:
    """Fit on ``labelled`` (text, toxic), a bounded set. ``strength`` weighs the squared change of the score when group names are swapped. With one class only the model has that class's bias."""
    swap = swaps(IDENTITY_TERMS if terms is None else terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(f, p, k): texts with a feature, toxic ones and all, summed over a few texts at a time."""
        memory = Parts()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part, p, k = batch.slice(at, CHUNK), Counter(), Counter()
                for t, toxic in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    found = text_features(Counter(WORD.findall(t.as_py().lower())), memory)
                    k.update(found)
                    if toxic:
                        p.update(found)
                yield pa.RecordBatch.from_arrays([pa.array(list(k), pa.string()), pa.array([p[f] for f in k], pa.int64()), pa.array(list(k.values()), pa.int64())], ["f", "p", "k"])

    read = staged(labelled.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-fit")
    n = {r["toxic"]: r["count"] for r in read.groupBy("toxic").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return ToxicityModel({}, math.log((pos + 0.5) / (neg + 0.5)))
    seen = map_batches(read, count, "f string, p long, k long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("k").alias("k")).where(F.col("k") >= min_rows)
    k, rate = F.col("k"), pos / (pos + neg)
    gap = (F.col("p") - k * rate) / F.sqrt(k * rate * (1 - rate) + 1)
    features = [r["f"] for r in seen.orderBy(F.desc(F.abs(gap)), "f").limit(keep).select("f").collect()]
    at = {f: i for i, f in enumerate(features)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kept features of each text and, if it names a group, of the text with the names swapped."""
        memory = Parts()
        for batch in batches:
            own, other = [], []
            for t in batch.column(0):
                words = Counter(WORD.findall(t.as_py().lower()))
                own.append(sorted(at[f] for f in text_features(words, memory) if f in at))
                swapped: Counter = Counter()
                if words.keys() & swap.keys():
                    for w, n in words.items():
                        swapped[swap.get(w, w)] += n
                other.append(sorted(at[f] for f in text_features(swapped, memory) if f in at) if swapped else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], ["toxic", "x", "s"])

    rows = sorted((r["toxic"], r["x"], r["s"] is not None, r["s"] or []) for r in map_batches(read, number, "toxic int, x array<int>, s array<int>").collect())
    y = np.array([r[0] for r in rows], dtype=float)
    own, other = _sparse([r[1] for r in rows]), _sparse([r[3] for r in rows])
    named = np.array([r[2] for r in rows])
    w, b = _fit(own, other, named, y, len(features), strength, ridge, steps)
    return ToxicityModel({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-6}, b)


def _sparse(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([i for r in rows for i in r], dtype=np.int64)


def _fit(own: tuple, other: tuple, named: np.ndarray, y: np.ndarray, features: int, strength: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam on class-balanced logistic loss + ridge + strength x the mean squared change of the score over texts that name a group."""
    n, m = len(y), max(1, int(named.sum()))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, b = np.zeros(features), 0.0
    m1, m2, rate = np.zeros(features + 1), np.zeros(features + 1), 0.1
    score = lambda rc: np.bincount(rc[0], weights=w[rc[1]], minlength=n)
    back = lambda rc, g: np.bincount(rc[1], weights=g[rc[0]], minlength=features)
    for step in range(1, steps + 1):
        z = score(own) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = back(own, g) + 2 * ridge * w
        if named.any():
            change = np.where(named, score(own) - score(other), 0.0) * (2 * strength / m)
            grad += back(own, change) - back(other, change)
        full = np.append(grad, g.sum())
        m1 = 0.9 * m1 + 0.1 * full
        m2 = 0.999 * m2 + 0.001 * full**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step % 100 == 0:
            rate /= 2
    return w, float(b)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", reject: float = REJECT) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if score >= ``reject``) of each whole text.

    Null and empty texts get the score of the bias; texts are read whole, however long; repeated rows are scored alike; an empty table
    gives an empty one. Input columns named like an output stay as ``<name>_in``, the text's too.
    """
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    df = set_aside(df, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = sent.value, {}
        for batch in batches:
            scores = pa.array([model.score(t.as_py(), memory) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return map_batches(df, run, schema_with(df, "score double")).withColumn("predicted", (F.col("score") >= reject).cast("int"))


def model_for(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learned from labelled rows outside the held-out third."""
    free = ~held_out(F.col("doc_id"))
    return train(fit_rows(docs.where(free), labels.where(free)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = model_for(docs, load(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
