"""Language identification by words first, then ever shorter character n-grams for words never seen."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.shared import held_out, load, map_batches, schema_with, set_aside, staged

WORD = regex.compile(r"\p{L}+")
#: Labelled rows of each language that the model learns from on average, at most; which ones depends on a hash of the row. All their words and n-grams are kept.
FIT_ROWS = 4_000
LONGEST = 5
#: Share of a frequency that comes from all languages together: languages that lack an entry all get the same, less than one that has it.
BACKGROUND = 0.01
#: Unseen words that a worker remembers the scores of.
REMEMBERED = 200_000


@dataclass
class Frequencies:
    """Log frequencies: a row of ``table`` for each entry, a column for each language."""

    at: dict[str, int] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), dtype=np.float32))

    def __contains__(self, entry: str) -> bool:
        return entry in self.at

    def __len__(self) -> int:
        return len(self.at)


@dataclass
class LanguageModel:
    """What was learned: the languages, words, and the n-grams of each length from 1."""

    langs: list[str]
    prior: np.ndarray
    words: Frequencies = field(default_factory=Frequencies)
    ngrams: list[Frequencies] = field(default_factory=list)

    def word_scores(self, word: str) -> np.ndarray:
        """Log frequency of a known word; else the mean over the longest of its n-grams (with edges) that the model knows any of; else zeros."""
        row = self.words.at.get(word)
        if row is not None:
            return self.words.table[row]
        edged = f" {word} "
        for n in range(min(len(self.ngrams), len(edged)), 0, -1):
            known = self.ngrams[n - 1]
            rows = [r for i in range(len(edged) - n + 1) if (r := known.at.get(edged[i : i + n])) is not None]
            if rows:
                return known.table[rows].sum(axis=0) / len(rows) if len(rows) > 1 else known.table[rows[0]]
        return np.zeros(len(self.langs), dtype=np.float32)

    def classify(self, text: str | None, memory: Memory) -> tuple[str, float]:
        """(language, posterior). ``und`` with 0 if there is no letter or no model; else the language of the best mean score, of equal ones the first by name."""
        words = Counter(WORD.findall(text.lower())) if text else {}
        if not words or not self.langs:
            return "und", 0.0
        known, seen, others, n = self.words.at, [], [], 0
        for word, k in words.items():
            row = known.get(word)
            if row is not None:
                seen.append((row, k))
            else:
                others.append((word, k))
            n += k
        total = np.zeros(len(self.langs))
        if seen:
            rows, counts = zip(*seen, strict=True)
            total += np.array(counts, dtype=np.float32) @ self.words.table[list(rows)]
        for at in range(0, len(others), REMEMBERED):  # a very long text has more unseen words than are remembered at once
            part = others[at : at + REMEMBERED]
            total += np.array([k for _, k in part], dtype=np.float32) @ memory.scores([w for w, _ in part], self)
        # Words of a text depend on each other: its evidence grows as the root of their number.
        z = total / math.sqrt(n) + self.prior
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


class Memory:
    """Scores of unseen words that a worker has met, as rows of one table; starts anew when it is full."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, 0), dtype=np.float32)

    def scores(self, words: list[str], model: LanguageModel) -> np.ndarray:
        """A row for each word, of ``REMEMBERED`` words at most."""
        if not len(self.table):
            self.table = np.zeros((REMEMBERED, len(model.langs)), dtype=np.float32)
        if len(self.at) + len(words) > REMEMBERED:
            self.at.clear()
        at, rows = self.at, []
        for w in words:
            row = at.get(w)
            if row is None:
                row = at[w] = len(at)
                self.table[row] = model.word_scores(w)
            rows.append(row)
        return self.table[rows]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) summed over each batch, before anything is shuffled."""
    for batch in batches:
        by_lang: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            by_lang[lang].update(WORD.findall(text.as_py().lower()))
        rows = [(lang, word, n) for lang, words in by_lang.items() for word, n in words.items()]
        if rows:
            langs, words, ns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "n"])


def _learned(counted: DataFrame, langs: list[str]) -> Frequencies:
    """Log relative frequencies of (lang, gram, n), mixed with those over all languages."""
    rows = counted.select("lang", "gram", "n").toArrow()
    if not rows.num_rows:
        return Frequencies()
    grams = rows.column("gram").combine_chunks().dictionary_encode()
    of_lang = {x: i for i, x in enumerate(langs)}
    n = np.zeros((len(grams.dictionary), len(langs)))
    np.add.at(n, (grams.indices.to_numpy(), np.array([of_lang[x] for x in rows.column("lang").to_pylist()])), rows.column("n").to_numpy())
    totals = n.sum(axis=0)
    p = BACKGROUND * n.sum(axis=1, keepdims=True) / totals.sum() + (1 - BACKGROUND) * n / np.maximum(totals, 1)
    v = np.log(p)
    return Frequencies({g: i for i, g in enumerate(grams.dictionary.to_pylist())}, (v - v.max(axis=1, keepdims=True)).astype(np.float32))


def fit_rows(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of about ``rows`` rows of each language, of all rows where it has fewer; drawn by a hash of the whole row."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r["l"]: r["n"] for r in known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    often = {x: n for x, n in counts.items() if n > rows}
    if often:
        n = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in often.items() for v in kv]), F.col(lang)), F.lit(1))
        known = known.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns]), n) < rows)
    return known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS, longest: int = LONGEST) -> LanguageModel:
    """Count the words of about ``rows`` rows of each language (``fit_rows``) and keep all of them, and all n-grams of up to ``longest`` characters.

    N-grams are counted over distinct words, weighted by how often these occur. The model's size is bounded by that of the rows it
    is fitted on, whatever the input. Rows without a text or a language are left out; without any row the model knows no language.
    """
    counted = map_batches(fit_rows(labelled, text, lang, rows), _counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = staged(counted, "words")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return LanguageModel([], np.zeros(0))
    prior = np.array([0.1 * math.log(totals[x] / sum(totals.values())) for x in langs])
    model = LanguageModel(langs, prior, _learned(counted.withColumnRenamed("word", "gram"), langs))
    edges = counted.select("lang", F.concat(F.lit(" "), "word", F.lit(" ")).alias("word"), "n")
    for n in range(1, longest + 1):
        cut = F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substring(F.col("word"), i, F.lit(n)))  # noqa: B023
        grams = edges.where(F.length("word") >= n).select("lang", F.explode(cut).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        model.ngrams.append(_learned(grams, langs))
    return model


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (0 to 1) of each whole text, however long. Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learned. Repeated rows are judged alike, an empty table gives an empty one. Input columns named like an output stay as ``<name>_in``."""
    df = set_aside(df, ["lang_pred", "score"])
    text = text if text in df.columns else f"{text}_in"
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    schema = schema_with(df, "lang_pred string, score double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = sent.value, Memory()
        for batch in batches:
            found = [model.classify(t.as_py(), memory) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(df, predict, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
