"""What is known of frequent shingles orders keys and deals rows over tasks; no group depends on it."""

import random

import numpy as np
import pytest

from clearbrook.llm import simhash


def groups(spark, rows):
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), longest=4).collect()
    of = {}
    for r in out:
        of.setdefault(r.group_id, set()).add(r.doc_id)
    return set(map(frozenset, of.values()))


@pytest.mark.parametrize("known", ["none", "some", "wrong"])
def test_groups_equal_brute_force_whatever_is_known_as_frequent(spark, monkeypatch, known):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    license_line = " ".join(r.choices(words, k=15))
    rows = []
    for i in range(24):
        base = r.choices(words, k=90)
        cut = r.randrange(80)
        for t in (base, [*base, *r.choices(words, k=8)], base[7:], [*base[:cut], "x", *base[cut + 1 :]]):
            rows.append((len(rows), " ".join(t) + " " + license_line))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    want = {frozenset(i for i, g in enumerate(group) if g == k) for k in set(group)}
    shingles = np.unique(np.concatenate([np.array(sorted(x), dtype=np.uint64) for x in sets]))
    some = {"none": shingles[:0], "some": shingles[::3], "wrong": shingles}[known]
    counts = np.random.default_rng(1).integers(1, 9000, len(some))
    monkeypatch.setattr(simhash, "_frequent_shingles", lambda texts, size, n: (some, counts, 2.0))
    assert groups(spark, rows) == want and len(want) < 60
