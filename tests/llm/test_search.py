"""Nearest neighbours, phrases and periodic runs against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearbrook.llm import neighbours, runs
from clearbrook.llm.neighbours import nearest
from clearbrook.llm.phrases import mine_phrases
from clearbrook.llm.runs import find_runs, with_runs


def nearest_by_force(rows, asks, k):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = max(best.get(i, v), v)
    out = []
    for q in sorted(i for i in best if asks(i)):
        near = sorted((-sum((x * y for x, y in zip(best[q], v)), 0.0), i) for i, v in best.items() if i != q and len(v) == len(best[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    draw = lambda: [float(np.float32(rng.gauss(0, 1) * rng.choice([1, 1, 3]))) for _ in range(6)]
    rows = [(i, draw()) for i in range(900)]
    rows += [(i, [1.0, 2.0, 0.5, 0.0, -1.0, 0.25]) for i in range(900, 1300)]  # one vector of very many ids
    rows += [(1300 + i, [float(rng.randrange(3)) for _ in range(6)]) for i in range(300)]  # ties
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2004, [float("nan")] * 6), (2006, [float("inf")] * 6), (None, [1.0] * 6), (2010, [1.0, 2.0]), (2020, [3.0, 1.0]), (40, draw()), (60, rows[60][1])]
    return rows


def test_factor_one_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    df = spark.createDataFrame([(*r, 1) for r in vectors], VECTORS)
    want = nearest_by_force(vectors, lambda i: i % 20 == 0, 20)
    got = nearest(df, F.col("vec_id") % 20 == 0, factor=1, shard_rows=300, block_rows=40)
    assert sorted(map(tuple, got.collect())) == [(q, n, i, pytest.approx(s, abs=1e-12)) for q, n, i, s in want]


def test_relaxed_pruning_keeps_recall_and_prunes(vectors):
    rows = np.array([v for _, v in vectors[:900]])
    exact, held = nearest_by_force([(i, list(v)) for i, v in enumerate(rows)], lambda i: i < 100, 10), {}
    small, neighbours.LEAF = neighbours.LEAF, 16
    try:
        tree = neighbours.Tree(np.arange(900), rows)
        for factor in (1, 0.8, 0.02):
            who, place = tree.search(rows[:100], 11, factor)
            ids = tree.ids[tree.first[place]]
            pairs = set(zip(who.tolist(), ids.tolist()))
            held[factor] = np.mean([(q, i) in pairs for q, _, i, _ in exact])
    finally:
        neighbours.LEAF = small
    assert held[1] == 1 and held[0.8] > 0.9 and held[0.02] < held[0.8]


def test_neighbours_of_few_or_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 1.0], 1), (7, [2.0, 0.0], 1), (9, [0.0, 2.0], 1)], VECTORS).withColumns({"score": F.lit("x"), "rank": F.lit(1), "size": F.lit(2), "shard": F.lit(0)})
    assert sorted(map(tuple, nearest(few, F.col("vec_id") % 20 == 0).collect())) == [(0, 1, 7, 2.0), (0, 2, 9, 2.0)]


def phrases_by_force(rows, least, longest, top, cover=80):
    n, f, left, right, out = Counter(), defaultdict(Counter), Counter(), Counter(), []
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    g = tuple(w[i : i + k])
                    f[lang][g] += 1
                    left[lang, g] += i > 0
                    right[lang, g] += i + k < len(w)
    for lang in f:
        candidates = {g: a for g, a in f[lang].items() if len(g) > 1 and a >= least}
        held = Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i : i + k]] = max(held[g[i : i + k]], a)
        scored = []
        for g, a in candidates.items():
            if not 100 * held[g] >= cover * a:
                score, k = min((2000000 * a // (f[lang][g[:k]] + f[lang][g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), f[lang][g[:k]], f[lang][g[k:]], left[lang, g], right[lang, g]))
        out += [(lang, i + 1, p.decode(), -a, lf, r, n[lang], -s, lx, rx) for i, (s, a, p, lf, r, lx, rx) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,longest,top,size", [(4, 4, 25, 50), (3, 3, 2000, 1 << 20), (4, 4, 2000, 300)])
def test_phrases_equal_brute_force(spark, least, longest, top, size):
    rng, rows = random.Random(least + size), []
    for _ in range(90):
        words = [rng.choice(["a", "B", "c", "dé", "É", "e\x01", "f", "\x85"] + [f"x{rng.randrange(60)}" for _ in range(6)]) for _ in range(rng.choice([0, 3, 40, 80]))]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", "\x0b"]) for w in words) + ". the quick brown fox jumps over. " * (rng.random() < 0.2)
        rows.append((text if rng.random() > 0.02 else None, rng.choice(["en", "de", None])))
    rows += [("one one one one one one one. " * 40, "en")] * 2
    df = spark.createDataFrame(rows, "text string, lang string").withColumns({"phrase": F.lit(1), "shard": F.lit("x"), "n": F.lit(None).cast("int")})
    got = mine_phrases(df, least=least, longest=longest, top=top, shard_words=size).collect()
    assert sorted(map(tuple, got)) == phrases_by_force(rows, least, longest, top)


def test_phrases_of_nothing(spark):
    schema = "text string, lang string"
    assert mine_phrases(spark.createDataFrame([], schema)).collect() == []
    assert mine_phrases(spark.createDataFrame([(None, "en"), ("", None), ("a b c", "en")], schema)).collect() == []


def runs_by_force(t):
    found = {}
    for q in range(1, len(t) // 2 + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q - s), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("grid,queries", [(runs.GRID_WORDS, runs.QUERIES), (40, 64)])
def test_runs_equal_brute_force(monkeypatch, grid, queries):
    monkeypatch.setattr(runs, "GRID_WORDS", grid)
    monkeypatch.setattr(runs, "QUERIES", queries)
    rng = random.Random(grid)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(1, 5)):
            t = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 11, 12, 13, 30, 60, 100]))]
            p, s = rng.randint(1, 8), rng.randint(0, 10)
            for i in range(s + p, min(len(t), s + rng.randint(p, 60))):
                t[i] = t[i - p]
            texts.append(t)
        got = find_runs([np.array(t, np.int64) for t in texts], 5)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [runs_by_force(t) for t in texts]


def test_texts_are_described_and_collapsed(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a " * 40, "x\xa0y " * 13 + "end", "a b c " * 5 + "d", " ".join(rng.choice("ab") for _ in range(300)), "la la " * 3000 + "z", "a b c " * 5 + "d"]
    rows = [(i if i else None, t, "own", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, runs int")
    for key in (None, "doc_id"):
        for r in with_runs(df, key=key, spans=True).collect():
            words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
            words = runs.planted(words, r.doc_id) if key else words
            want = runs_by_force(words)
            dropped = {i for s, n, q in want for i in range(s + q, s + n)}
            kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
            best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=None)
            assert (r.start_in, r.runs_in, r.n_runs) == ("own", 5, len(want)) and [tuple(x) for x in r.runs] == want
            assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
            assert r.collapsed == kept and r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
    assert with_runs(df.limit(0)).collect() == []


def test_every_tenth_text_is_made_periodic():
    import zlib

    words = [f"w{i}" for i in range(50)]
    for key in range(200):
        h = zlib.crc32(str(key).encode())
        a = (h // 10) % 50
        p = 1 + (50 - a) // (3 + (h // 10) % 8)
        assert runs.planted(words, key) == (words if h % 10 else [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)])
