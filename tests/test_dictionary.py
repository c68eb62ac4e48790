"""Dictionary passes over text against the same rules applied entry by entry."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clearbrook.functions.text import dictionary_replaced, fold_replaced
from clearbrook.functions.values import TEXT_ABBREVIATIONS, TEXT_MISSPELLINGS
from clearbrook.operators import documents


def texts():
    rng = random.Random(4)
    words = [*TEXT_ABBREVIATIONS, *TEXT_ABBREVIATIONS.values(), *TEXT_MISSPELLINGS, *TEXT_MISSPELLINGS.values(), "the", "x", "bp2", "_bp", "émt", "Parkinson's", "oxycodones", "mi"]
    case = [str.lower, str.upper, str.title, str]
    out = ["".join(rng.choice(case)(rng.choice(words)) + rng.choice([" ", " ", ", ", "-", "\n", "", "'s "]) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(150)]
    return [*out, None, "", "BP", "bp bp", "plain ﷐ text", "$1 bp \\2"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "k int, text string").cache()


@pytest.mark.parametrize("table", [documents.LONG_FORMS, TEXT_MISSPELLINGS])
def test_one_pass_equals_entry_by_entry(rows, table):
    both = rows.select("text", dictionary_replaced(F.col("text"), table).alias("a"), fold_replaced(F.col("text"), table, True).alias("b")).collect()
    assert all(r.a == r.b for r in both if r.text) and sum(r.a.n for r in both) > 200
    assert {r.a.text for r in both if not r.text} == {None, ""}


def test_entries_that_depend_on_each_other_are_applied_in_turn(spark):
    table = {"a": "b", "b": "c", "a b": "z"}
    df = spark.createDataFrame([("a b c",)], "text string")
    assert df.select(dictionary_replaced(F.col("text"), table)["text"].alias("t")).first().t == "c c c"


def test_mentions_equal_a_search_for_each_term(rows):
    terms = [(v, rf"\b(?:{re.escape(k)}|{re.escape(v)})\b") for k, v in TEXT_ABBREVIATIONS.items()] + [(v[:1].upper() + v[1:], rf"\b{re.escape(v)}\b") for v in set(TEXT_MISSPELLINGS.values())]
    want = set()
    for r in rows.collect():
        first = {}
        for concept, pattern in terms:
            for m in re.finditer(pattern, r.text or "", re.IGNORECASE):
                key = concept, m.start() // 50
                first[key] = min(first.get(key, (m.start(), m[0])), (m.start(), m[0]))
        want |= {(r.k, concept, text, at) for (concept, _), (at, text) in first.items()}
    got = documents.mentions(rows, "k").collect()
    got = {tuple(r) for r in got}
    assert (got - want, want - got) == (set(), set()) and len(want) > 300
    assert documents.mentions(rows.limit(0), "k").collect() == []
