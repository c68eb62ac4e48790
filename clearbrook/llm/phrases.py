"""Collocations: phrases whose words meet far more often than apart, from exact counts of all short phrases.

Texts are gathered into shards of a bounded number of words. A shard is a sequence of word numbers with a full-text index of
both directions (bounded-context Burrows-Wheeler transforms). A phrase is an interval of each; all its extensions to the right are read
from the transform of the reversed sequence in that interval, which gives their intervals in both indexes, their counts,
and how many occurrences go on to the left and to the right. Counts are summed across shards.

Only what can reach the least count is enumerated: words, and then pairs of words, are first summed across shards. A shard
sends its entries to buckets by their hash, a bucket adds them up and tells each shard which of its own are frequent. Every
exchange is one row for each shard and bucket, so that no word or phrase is hot, and no dictionary is sent to all.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.shared import load, map_batches, staged

#: A shard is closed at the first piece that ends beyond so many words; a piece is never cut.
SHARD_WORDS = 1 << 21
LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Rows of a language are ranked in so many parts, then the best of all parts.
PARTS = 64
#: Bytes that end a piece, and what they become: 0xFF is in no UTF-8 text.
CUT = b"\xff"
MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", CUT * 10 + b" ")
#: In a coded text: the end of a piece, and a word that is in no candidate.
END, RARE = -1, 0


class Numbers(dict):
    """Numbers its keys from 0 as they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def pack(*arrays: np.ndarray) -> bytes:
    data = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(blob: bytes, kind: str, columns: int = 1) -> np.ndarray:
    data = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(data, kind).reshape(columns, -1)


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of entries by bucket, and (bucket, begin, end) of each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(bucket)]))


class PhraseIndex:
    """Both transforms of a sequence: symbol 0 is the end of a piece, 1 a cut beside a word that is left out, words from 2 on.
    The sequence begins and ends with a 0 or 1."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.symbols, self.depth = int(text.max(initial=1)) + 1, depth
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        before = self._transformed(text)
        self.after = self._transformed(text[::-1])  # what follows, in the order of reversed contexts
        self.left, self.right = (np.concatenate([[0], np.cumsum(x != 0)]) for x in (before, self.after))
        self.step = np.empty(len(text), np.int64)
        self.step[np.argsort(self.after, kind="stable")] = np.arange(len(text))

    def _transformed(self, text: np.ndarray) -> np.ndarray:
        """The symbols before the suffixes of ``text`` in the order of their first ``depth`` symbols."""
        rank, size = text.astype(np.int64), 1
        while size < self.depth:
            if size > 1:
                _, rank = np.unique(rank, return_inverse=True)
            behind = np.zeros(len(rank), np.int64)
            behind[:-size] = rank[size:] + 1
            rank = rank * (int(rank.max(initial=0)) + 2) + behind
            size *= 2
        return text[np.argsort(rank, kind="stable") - 1]

    def phrases(self) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 2 to the depth: the words of all phrases, their counts, and how often they go on to the left and right."""
        words = np.arange(2, self.symbols)
        low, many = self.starts[words], np.diff(self.starts)[words]
        words, low, many = words[many > 0], low[many > 0], many[many > 0]
        columns, forward = [words], low
        for _ in range(1, self.depth):
            begin = np.cumsum(many) - many
            of = np.repeat(np.arange(len(many)), many)
            at = (low - begin)[of] + np.arange(len(of))
            key = of * self.symbols + self.after[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            size, parent = np.diff(np.append(first, len(key))), key[first] // self.symbols
            symbol = key[first] - parent * self.symbols
            keep = symbol > 1
            first, many, parent, symbol = first[keep], size[keep], parent[keep], symbol[keep]
            columns = [*(c[parent] for c in columns), symbol]
            low, forward = self.step[at[order[first]]], forward[parent] + first - begin[parent]
            yield columns, many, self.left[forward + many] - self.left[forward], self.right[low + many] - self.right[low]


def shards(df: DataFrame, text: str, lang: str, size: int) -> DataFrame:
    """Rows of shard, keys (language, 0xFF, word), counts of each, numbers of words of each language, and the texts as places in keys with -1 after each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbers()
        parts: list[np.ndarray] = []
        held = 0
        sizes: Counter[str] = Counter()

        def close() -> pa.RecordBatch:
            nonlocal held
            whole = np.concatenate(parts)
            keys, counts = list(number), np.bincount(whole[whole >= 0], minlength=len(number))
            row = [pa.array([uuid.uuid4().hex]), pa.array([keys], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([list(sizes)], pa.list_(pa.string())), pa.array([list(sizes.values())], pa.list_(pa.int64())), pa.array([pack(whole)], pa.binary())]
            sizes.clear()
            number.clear()
            parts.clear()
            held = 0
            return pa.RecordBatch.from_arrays(row, ["shard", "keys", "counts", "langs", "sizes", "coded"])

        for batch in batches:
            for value, code in zip(batch.column(0), batch.column(1).to_pylist()):
                tokens = (value.as_py() or "").encode().lower().translate(MARKS).replace(CUT, b" \xff ").split()
                prefix = code.encode() + CUT
                begin = 0
                while begin < len(tokens):
                    end = begin + size
                    while end < len(tokens) and tokens[end] != CUT:
                        end += 1
                    part = tokens[begin : end + 1]
                    own = {w: END if w == CUT else number[prefix + w] for w in set(part)}
                    parts.append(np.fromiter(map(own.__getitem__, part), np.int32, len(part)))
                    parts.append(np.array([END], np.int32))
                    held += len(part)
                    sizes[code] += len(part) - part.count(CUT)
                    begin = end + 1
                    if held >= size:
                        yield close()
        if parts:
            yield close()

    few = df.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return map_batches(few, run, "shard string, keys array<binary>, counts array<long>, langs array<string>, sizes array<long>, coded binary")


def word_buckets(keys: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(k) % buckets for k in keys), np.int64, len(keys))


def word_totals(parts: DataFrame, buckets: int, least: int) -> DataFrame:
    """Two kinds of rows for each bucket: with a shard, the numbers of its words there (0: rare), packed; without, all frequent words with their numbers and counts."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, keys, counts in zip(batch.column(0), batch.column(1), batch.column(2)):
                names, values = keys.values, counts.values.to_numpy(zero_copy_only=False)
                order, cuts = by_bucket(word_buckets(names.to_pylist(), buckets))
                at = pa.array(order)
                lists = pa.array([b for _, b, _ in cuts] + [len(order)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in cuts], pa.int32()), pa.array([shard.as_py()] * len(cuts)), pa.ListArray.from_arrays(lists, names.take(at)), pa.ListArray.from_arrays(lists, pa.array(values[order]))],
                    ["bucket", "shard", "keys", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        bucket, all_keys, totals = table.column("bucket")[0].as_py(), table.column("keys").to_pylist(), Counter()
        for keys, counts in zip(all_keys, table.column("counts").to_pylist()):
            for k, c in zip(keys, counts):
                totals[k] += c
        frequent = sorted(k for k, c in totals.items() if c >= least)
        number = {k: 1 + bucket + buckets * i for i, k in enumerate(frequent)}
        answers = [pack(np.fromiter((number.get(k, RARE) for k in keys), np.uint32, len(keys))) for keys in all_keys]
        rows = len(all_keys)
        nothing: list = [None] * rows
        named = [k.partition(CUT) for k in frequent]
        return pa.table(
            {
                "bucket": pa.array([bucket] * (rows + 1), pa.int32()), "shard": pa.array([*table.column("shard").to_pylist(), None], pa.string()), "answer": pa.array([*answers, None], pa.binary()),
                "langs": pa.array([*nothing, [x.decode() for x, _, _ in named]], pa.list_(pa.string())), "words": pa.array([*nothing, [w.decode() for _, _, w in named]], pa.list_(pa.string())), "numbers": pa.array([*nothing, list(number.values())], pa.list_(pa.int64())), "totals": pa.array([*nothing, [totals[k] for k in frequent]], pa.list_(pa.int64())),
            }
        )

    scattered = map_batches(parts.select("shard", "keys", "counts"), scatter, "bucket int, shard string, keys array<binary>, counts array<long>")
    return scattered.groupBy("bucket").applyInArrow(add, "bucket int, shard string, answer binary, langs array<string>, words array<string>, numbers array<long>, totals array<long>")


class Shard:
    """A shard as its group of rows gives it: its text in global word numbers, and its distinct pairs of frequent words in the order of their buckets."""

    def __init__(self, left: pa.Table, right: pa.Table, buckets: int) -> None:
        keys, answers = left.column("keys")[0].values.to_pylist(), self._answers(right, "word")
        order, _ = by_bucket(word_buckets(keys, buckets))
        number = np.zeros(len(keys) + 1, np.int64)
        number[order] = np.concatenate([unpack(a, "u4")[0] for a in answers]) if answers else 0
        number[-1] = END  # place -1
        self.name, self.text, self.right = left.column("shard")[0].as_py(), number[unpack(left.column("coded")[0].as_py(), "i4")[0]], right
        self.at = np.flatnonzero((self.text[:-1] > 0) & (self.text[1:] > 0))
        self.key = (self.text[self.at] << 32) | self.text[self.at + 1]

    @staticmethod
    def _answers(right: pa.Table, kind: str) -> list[bytes]:
        rows = [(b, a) for k, b, a in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("answer")) if k == kind]
        return [a.as_py() for _, a in sorted(rows, key=lambda r: r[0])]

    def chains(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of words of which all neighbours are frequent pairs, as a sequence for `PhraseIndex`, and the numbers of its words."""
        pairs, of = np.unique(self.key, return_inverse=True)
        order, cuts = by_bucket((mixed(pairs) % np.uint64(buckets)).astype(np.int64))
        frequent = np.zeros(len(pairs), bool)
        bits = [np.unpackbits(np.frombuffer(a, np.uint8), count=end - begin) for a, (_, begin, end) in zip(self._answers(self.right, "pair"), cuts, strict=True)]
        frequent[order] = np.concatenate(bits).astype(bool) if bits else False
        text, linked = self.text, np.zeros(len(self.text) + 1, bool)  # linked[p + 1]: place p and the next
        linked[self.at + 1] = frequent[of]
        begins, ends = ~linked[:-1] & linked[1:], linked[:-1] & ~linked[1:]
        inside = np.flatnonzero(linked[:-1] | linked[1:])
        begins, ends = begins[inside], ends[inside]
        place = np.cumsum(1 + begins + ends) - 1 - ends
        around = np.concatenate([[END], text, [END]])
        out = np.empty(int(place[-1] + 2) if len(place) else 0, np.int64)
        numbers, local = np.unique(text[inside], return_inverse=True)
        out[place] = local + 2
        out[place[begins] - 1] = around[inside[begins]] != END
        out[place[ends] + 1] = around[inside[ends] + 2] != END
        return out, numbers


def pair_totals(parts: DataFrame, answers: DataFrame, buckets: int, least: int) -> DataFrame:
    """For each shard and bucket, which of the shard's distinct pairs there are frequent, as bits."""

    def scatter(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left, right, buckets)
        pairs, counts = np.unique(shard.key, return_counts=True)
        order, cuts = by_bucket((mixed(pairs) % np.uint64(buckets)).astype(np.int64))
        pairs, counts = pairs[order], counts[order]
        blobs = [pack(np.diff(pairs[b:e] >> 32, prepend=0).astype(np.uint32), (pairs[b:e] & 0xFFFFFFFF).astype(np.uint32), counts[b:e].astype(np.uint32)) for _, b, e in cuts]
        return pa.table({"bucket": pa.array([b for b, _, _ in cuts], pa.int32()), "shard": pa.array([shard.name] * len(cuts), pa.string()), "pairs": pa.array(blobs, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        each = [unpack(b.as_py(), "u4", 3) for b in table.column("pairs")]
        keys = np.concatenate([(np.cumsum(x[0], dtype=np.int64) << 32) | x[1] for x in each])
        _, of = np.unique(keys, return_inverse=True)
        frequent = (np.bincount(of, np.concatenate([x[2] for x in each])) >= least)[of]  # exact: sums below 2**53
        cuts = np.cumsum([x.shape[1] for x in each])[:-1]
        return table.select(["bucket", "shard"]).append_column("answer", pa.array([np.packbits(b).tobytes() for b in np.split(frequent, cuts)], pa.binary()))

    scattered = parts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(scatter, "bucket int, shard string, pairs binary")
    return scattered.groupBy("bucket").applyInArrow(add, "bucket int, shard string, answer binary")


def phrase_totals(parts: DataFrame, answers: DataFrame, buckets: int, least: int, longest: int) -> DataFrame:
    """All phrases of 2 to ``longest`` words that occur ``least`` times or more: w1, w2, ... (numbers; 0 after the last), f, left, right."""
    numbers = [f"w{i}" for i in range(1, longest + 1)]

    def scatter(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left, right, buckets)
        text, own = shard.chains(buckets)
        made: list[tuple[int, bytes]] = []
        for columns, *counts in PhraseIndex(text, longest).phrases() if len(text) else ():
            words = [own[c - 2].astype(np.uint32) for c in columns]
            order, cuts = by_bucket((mixed(*words) % np.uint64(buckets)).astype(np.int64))
            rows = [x[order].astype(np.uint32) for x in (*words, *([np.zeros(len(order))] * (longest - len(words))), *counts)]
            made += [(b, pack(*(x[begin:end] for x in rows))) for b, begin, end in cuts]
        return pa.table({"bucket": pa.array([b for b, _ in made], pa.int32()), "phrases": pa.array([x for _, x in made], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        rows = np.concatenate([unpack(b.as_py(), "u4", longest + 3) for b in table.column("phrases")], 1).astype(np.int64)
        order = np.lexsort(rows[longest - 1 :: -1])
        rows = rows[:, order]
        first = np.flatnonzero(np.concatenate([[True], (rows[:longest, 1:] != rows[:longest, :-1]).any(0)]))
        sums = np.add.reduceat(rows[longest:], first, 1)
        keep = sums[0] >= least
        return pa.table({n: pa.array(x[keep]) for n, x in zip([*numbers, "f", "left", "right"], [*rows[:longest, first], *sums])})

    scattered = parts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(scatter, "bucket int, phrases binary")
    return scattered.groupBy("bucket").applyInArrow(add, ", ".join(f"{n} long" for n in [*numbers, "f", "left", "right"]))


def mine_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score, left, right.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, and words are parted by spaces and tabs. a is how often the phrase (2 to
    ``longest`` words, ``least`` times or more) occurs within pieces, n the number of words of the language, score the least
    floor(2000000 a / (l + r)) of its cuts (ties: the shortest first part), where l and r are how often the parts occur. left and right: how many
    occurrences have a further word of the piece on that side. A phrase that some longer candidate holds, which
    occurs at least ``cover`` per cent as often, is left out. Ties in score go to the larger a, then the smaller phrase in bytes.

    Null texts are empty, null languages ``und``; repeated rows count each; an empty table, or one of only rare phrases, gives an empty
    one. Texts are taken whole, however long; other columns are not read.
    """
    numbers = [f"w{i}" for i in range(1, longest + 1)]
    spark = df.sparkSession
    parts = staged(shards(df, text, lang, shard_words), "phrase-shards")
    buckets = max(parts.count(), 2 * spark.sparkContext.defaultParallelism)
    words = staged(word_totals(parts, buckets, least), "phrase-words")
    coded = parts.select("shard", "keys", "coded")
    told = words.where(F.col("shard").isNotNull()).select("shard", "bucket", F.lit("word").alias("kind"), "answer")
    pairs = staged(pair_totals(coded, told, buckets, least), "phrase-pairs")
    told = told.unionByName(pairs.select("shard", "bucket", F.lit("pair").alias("kind"), "answer"))
    counted = staged(phrase_totals(coded, told, buckets, least, longest), "phrases")

    each = words.where(F.col("shard").isNull()).select(F.explode(F.arrays_zip("langs", "words", "numbers", "totals")).alias("x"))
    vocabulary = each.select(F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.numbers").alias("number"), F.col("x.totals").alias("f"))
    tallied = parts.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x"))
    languages = tallied.groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    return ranked(counted, vocabulary, languages, numbers, top, cover)


def ranked(counted: DataFrame, vocabulary: DataFrame, languages: DataFrame, numbers: list[str], top: int, cover: int) -> DataFrame:
    longest = len(numbers)
    ws = F.filter(F.array(*numbers), lambda w: w > 0)
    phrases = counted.select(ws.alias("p"), "f", "left", "right")
    known = phrases.select("p", "f").unionByName(vocabulary.select(F.array("number").alias("p"), "f"))

    def piece(p: Column, begin: Column, size: Column) -> Column:
        return F.slice(p, begin, size)

    cuts = F.sequence(F.lit(1), F.size("p") - 1)
    sides = F.flatten(F.transform(cuts, lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), piece(F.col("p"), F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), piece(F.col("p"), k + 1, F.size("p") - k).alias("part")))))
    asked = phrases.select("p", F.explode(sides).alias("x")).select("p", "x.k", "x.side", F.col("x.part").alias("part"))
    found = asked.join(known.select(F.col("p").alias("part"), F.col("f").alias("count")), "part").select("p", "k", "side", "count")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda b: piece(F.col("p"), b, n))))
    covers = phrases.where(F.size("p") > 2).select(F.explode(spans).alias("p"), F.lit(0).alias("k"), F.lit("cover").alias("side"), F.col("f").alias("count"))
    own = phrases.select("p", F.lit(0).alias("k"), F.lit("own").alias("side"), F.col("f").alias("count"), "left", "right")
    value = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("count")))
    every = own.unionByName(found, allowMissingColumns=True).unionByName(covers, allowMissingColumns=True)
    joined = every.groupBy("p").agg(
        value(0, "own").alias("a"), F.max("left").alias("left"), F.max("right").alias("right"), value(0, "cover").alias("cover"), *[value(k, s).alias(f"{s}{k}") for k in range(1, longest) for s in ("l", "r")]
    )
    joined = joined.where(f"cover is null or 100 * cast(cover as decimal(30)) < {int(cover)} * cast(a as decimal(30))")
    scores = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(2000000 * cast(a as decimal(20))) div (cast(l{k} as decimal(20)) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    scored = joined.withColumn("cut", F.array_min(F.array(*scores))).select("p", "a", "left", "right", "cut.score", "cut.l", "cut.r")

    spelled = scored.select("p", F.posexplode("p").alias("pos", "number")).join(vocabulary.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("p").agg(F.first("lang").alias("lang"), F.array_join(F.sort_array(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("phrase"))
    whole = scored.join(spelled, "p")
    best = "order by score desc, a desc, phrase"
    whole = whole.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.expr(f"row_number() over (partition by lang, part {best})")).where(F.col("rank") <= top)
    whole = whole.withColumn("rank", F.expr(f"row_number() over (partition by lang {best})")).where(F.col("rank") <= top)
    return whole.join(languages, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score", "left", "right")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(load(spark, sf_dir, "documents").select("text", "lang"))


OP12_SQL = r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS MATERIALIZED (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS p, k, count(*) AS f, count(*) FILTER (WHERE i > 1) AS lx, count(*) FILTER (WHERE i + k - 1 < len(w)) AS rx
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS ks(k)) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(p, ' ') AS ws FROM g WHERE k > 1 AND f >= 30),
held AS (SELECT lang, array_to_string(ws[b : b + m - 1], ' ') AS p, max(f) AS cover FROM (SELECT lang, ws, f, m, unnest(range(1, k - m + 2)) AS b FROM c, (VALUES (2), (3)) AS ms(m) WHERE m < k) GROUP BY ALL),
cut AS MATERIALIZED (SELECT lang, p, f AS a, lx, rx, j, array_to_string(ws[1 : j], ' ') AS px, array_to_string(ws[j + 1 : k], ' ') AS py FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
best AS (SELECT cut.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.p = px JOIN g y ON y.lang = cut.lang AND y.p = py QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.p ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, lx::BIGINT AS "left", rx::BIGINT AS "right"
FROM best JOIN n USING (lang) LEFT JOIN held USING (lang, p) WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a QUALIFY rank <= 2000
"""
