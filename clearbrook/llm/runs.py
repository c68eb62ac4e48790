"""Periodic runs of words by recompression.

The words of a batch of texts become one sequence in which a mark of its own follows each text. Blocks of equal symbols
and then pairs of neighbours are replaced by new symbols, level by level, until every text is one symbol: a run-length
grammar. Equal stretches are cut alike but near their ends, so how far two places agree is read from the grammar by
going up while both stand at the start of a rule, comparing one rule at most on each level, and down again after the first
difference. A run of period q that is at least 2q long holds two neighbouring multiples of q, so these places, a harmonic
grid of n ln n pairs, are all that has to be extended in both directions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clearbrook.llm.shared import load, map_batches, schema_with, set_aside

#: A run has so many words at least, and twice its period.
LEAST = 12
#: Texts are gathered until so many words are held: one grammar serves them all.
BATCH_WORDS = 1 << 18
#: Grids of texts up to so many words are taken from a table of divisors; longer texts make theirs period by period.
GRID_WORDS = 1 << 16
#: So many pairs of places are extended at once.
QUERIES = 1 << 18
OUTPUTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [field.split()[0] for field in OUTPUTS.split(", ")]
SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class Grammar:
    """Levels of a recompressed sequence. On level l, ``symbols[l]`` are its symbols; rule r of the next level covers
    the symbols from ``first[l][r]`` up to ``first[l][r + 1]``, and ``rule[l][p]`` is the rule over place p."""

    def __init__(self, symbols: np.ndarray, marks: int) -> None:
        """``symbols`` from 0; those of ``marks`` or more are marks, which no rule joins with anything."""
        self.symbols, self.first, self.rule, self.blocks = [symbols.astype(np.int64)], [], [], []
        mark, used, rounds = symbols >= marks, int(symbols.max(initial=0)) + 1, 0
        while len(mark) > 2 * int(mark.sum()):
            now = self.symbols[-1]
            starts = np.ones(len(now), bool)
            if rounds % 2 == 0:
                starts[1:] = (now[1:] != now[:-1]) | mark[1:]
            else:
                side = (now * np.int64(0x9E3779B1) + np.int64(rounds) * np.int64(0x85EBCA6B)) >> np.int64(7 + rounds % 11) & 1
                free = ~(mark[1:] | mark[:-1])
                up, down = free & (side[:-1] < side[1:]), free & (side[:-1] > side[1:])
                starts[1:] = ~(up if up.sum() >= down.sum() else down)
            first = np.flatnonzero(starts)
            rounds += 1
            if len(first) == len(now):
                continue
            ends = np.append(first[1:], len(now))
            made, size = now[first], ends - first
            wide = np.flatnonzero(size > 1)
            other = size[wide] if rounds % 2 else now[first[wide] + 1]
            _, name = np.unique(made[wide] * (np.int64(max(used, len(now))) + 1) + other, return_inverse=True)
            made[wide] = used + name
            used += int(name.max(initial=-1)) + 1
            self.first.append(np.append(first, len(now)))
            self.rule.append(np.cumsum(starts) - 1)
            self.blocks.append(bool(rounds % 2))
            self.symbols.append(made)
            mark = mark[first]

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from places i and j on are equal."""
        return self._extend(i, j, 1)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols right before places i and j are equal."""
        return self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Places are borders between symbols; ``look`` is the distance from a border to the symbol it meets on its way."""
        look, top = (0 if way > 0 else -1), len(self.first)
        a, b, height = i.astype(np.int64), j.astype(np.int64), np.full(len(i), top)
        going = np.arange(len(i))
        for level in range(top):
            symbols, first, rule = self.symbols[level], self.first[level], self.rule[level]
            x, y = a[going], b[going]
            p, q = rule[x + look], rule[y + look]
            left_x, left_y = (first[p + 1] - x, first[q + 1] - y) if way > 0 else (x - first[p], y - first[q])
            whole = (left_x == first[p + 1] - first[p]) & (left_y == first[q + 1] - first[q])
            same = symbols[x + look] == symbols[y + look]
            step = np.where(~whole & same, np.minimum(left_x, left_y), 0)
            x, y = x + way * step, y + way * step
            on = whole | (same & (left_x == left_y))
            a[going], b[going] = x, y
            height[going[~on]] = level
            going, x, y = going[on], x[on], y[on]
            if way > 0:
                a[going], b[going] = rule[x], rule[y]
            else:
                a[going], b[going] = rule[x - 1] + 1, rule[y - 1] + 1
        while len(going):  # on the top level a text is one symbol
            same = self.symbols[top][a[going] + look] == self.symbols[top][b[going] + look]
            going = going[same]
            a[going], b[going] = a[going] + way, b[going] + way
        for level in range(top - 1, -1, -1):
            down = np.flatnonzero(height > level)
            symbols, first = self.symbols[level], self.first[level]
            p, q = a[down], b[down]
            x, y = first[p], first[q]
            same = symbols[x + look] == symbols[y + look]
            if self.blocks[level]:
                step = np.minimum(first[p + 1] - x, first[q + 1] - y) if way > 0 else np.minimum(x - first[p - 1], y - first[q - 1])
            else:
                step = 1
            a[down], b[down] = x + way * np.where(same, step, 0), y + way * np.where(same, step, 0)
        return (a - i) * way


_grid: list[np.ndarray] = []


def grid_pairs(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): all multiples of a period but 0 below n, for all periods up to n / 2, in bounded portions."""
    if n <= GRID_WORDS:
        if not _grid:
            limit = 1 << 10
            _grid.extend(_divisors(limit))
        while len(_grid[2]) < n:
            _grid[:] = _divisors(min(GRID_WORDS, 4 * len(_grid[2])))
        upto = _grid[2][n - 1]
        yield _grid[0][:upto], _grid[1][:upto]
        return
    places, periods, held = [], [], 0
    for q in range(1, n // 2 + 1):
        for at in range(q, n, q * QUERIES):
            places.append(np.arange(at, min(n, at + q * QUERIES), q))
            periods.append(np.full(len(places[-1]), q))
            held += len(places[-1])
            if held >= QUERIES:
                yield np.concatenate(places), np.concatenate(periods)
                places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def _divisors(limit: int) -> list[np.ndarray]:
    """Places below ``limit`` with each of their divisors, by place; and how many pairs there are up to each place."""
    times = (limit - 1) // np.arange(1, limit)
    period = np.repeat(np.arange(1, limit), times)
    place = period * (np.arange(len(period)) - np.repeat(np.cumsum(times) - times, times) + 1)
    order = np.argsort(place, kind="stable")
    place, period = place[order], period[order]
    return [place.astype(np.int32), period.astype(np.int32), np.searchsorted(place, np.arange(limit), side="right")]


def find_runs(texts: list[np.ndarray], words: int) -> list[np.ndarray]:
    """For each text (numbers of its words, all below ``words``) its runs: rows of start, length and smallest period, by start and period."""
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1] + 1
    sequence = np.concatenate([[words], *(part for k, t in enumerate(texts) for part in (t, [words + 1 + k]))]).astype(np.int64)
    grammar, found, held = None, [[] for _ in texts], []

    def extend() -> None:
        nonlocal grammar
        if not held:
            return
        grammar = grammar or Grammar(sequence, words)
        text, j, q = (np.concatenate(x) for x in zip(*held))
        held.clear()
        back, on = grammar.before(j - q, j), grammar.after(j - q, j)
        start, length = j - q - back, back + on + q
        keep = (length >= LEAST) & (length >= 2 * q)
        rows = np.stack([text, start - at[text], length, q], 1)[keep]
        rows = np.unique(rows, axis=0)  # by text, start, length and period: the first of a stretch has its smallest period
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        rows = rows[fresh]
        for k, part in zip(*_grouped(rows)):
            found[k].append(part)

    many = 0
    for k, t in enumerate(texts):
        if len(t) < LEAST:
            continue
        for place, period in grid_pairs(len(t)):
            near = sequence[at[k] + place] == sequence[at[k] + place - period]
            j, q = at[k] + place[near].astype(np.int64), period[near].astype(np.int64)
            # A run agrees with itself q words on in six neighbouring places or more.
            beside = (sequence[j + 1] == sequence[j - q + 1]) | (sequence[j - 1] == sequence[j - q - 1])
            j, q = j[beside], q[beside]
            held.append((np.full(len(j), k), j, q))
            many += len(j)
            if many >= QUERIES:
                extend()
                many = 0
    extend()
    return [_smallest(np.concatenate(x)) if x else np.empty((0, 3), np.int64) for x in found]


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    texts, starts = np.unique(rows[:, 0], return_index=True)
    return texts, np.split(rows[:, 1:], starts[1:])


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the rows with one start and length, that of the smallest period; all by start and period."""
    rows = np.unique(rows, axis=0)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def split_words(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode().translate(SPACE).split()


def planted(words: list[bytes], key: object) -> list[bytes]:
    """The words of a text, every tenth of which by its key is made periodic from some word on."""
    h, n = zlib.crc32(b"" if key is None else str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def described(runs: np.ndarray, words: list[bytes], spans: bool) -> tuple:
    """The columns of one text."""
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode()
    longest = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d] if len(runs) else words
    best = (longest[0], longest[1], longest[2], 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    collapsed = b" ".join(kept)
    more = ([{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()], collapsed.decode()) if spans else ()
    return len(runs), *best, hashlib.sha256(lines).hexdigest(), hashlib.sha256(collapsed).hexdigest(), *more


def with_runs(df: DataFrame, text: str = "text", key: str | None = None, spans: bool = False) -> DataFrame:
    """``df`` with the periodic runs of words of each text.

    n_runs; start, length, period and exponent_milli of the longest run (ties: the smallest start, then period; null where there is
    none); runs_sha256 of all runs as lines ``start,length,period``; collapsed_sha256 of the words that stay when each run
    keeps its first period only. With ``spans``, also runs (array of structs) and collapsed (that text). With ``key``, the texts
    are first made periodic as `planted` says, by that column.

    Null and empty texts have no words and so no runs. Repeated rows are each described; an empty table gives an empty
    one; a text of any length is taken whole, in memory proportional to it. Input columns named like an output stay as ``<name>_in``.
    """
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if spans else ""
    names = NAMES + (["runs", "collapsed"] if spans else [])
    before = df.columns
    df = set_aside(df, names)
    at = before.index(text)
    key_at = before.index(key) if key else None
    schema = schema_with(df, OUTPUTS + more)

    def described_rows(texts: list[list[bytes]]) -> list[list]:
        number = defaultdict(count().__next__)
        coded = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
        columns: list[list] = [[] for _ in names]
        for words, runs in zip(texts, find_runs(coded, len(number))):
            for column, value in zip(columns, described(runs, words, spans)):
                column.append(value)
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        if spans:
            kinds += [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
        for batch in batches:
            texts, keys = batch.column(at), batch.column(key_at).to_pylist() if key else None
            begin, held, many = 0, [], 0
            for row in range(batch.num_rows):
                words = split_words(texts[row].as_py())
                held.append(planted(words, keys[row]) if key else words)
                many += len(words)
                if many >= BATCH_WORDS or row == batch.num_rows - 1:
                    part = batch.slice(begin, row + 1 - begin)
                    made = [pa.array(c, kind) for c, kind in zip(described_rows(held), kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *names])
                    begin, held, many = row + 1, [], 0

    return map_batches(df, run, schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return with_runs(docs, key="doc_id").select("doc_id", *NAMES)
