"""Similarity of short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearbrook.functions.text import let


def normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", " "))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table after the other, over characters that are split once."""

    def table(both: Column) -> Column:
        def row(last: Column, ch: Column) -> Column:
            step = lambda acc, c, i: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.get(last, i + 1), F.get(last, i) + F.when(c == ch, 1).otherwise(0))))
            at = F.transform(both["b"], lambda c, i: F.struct(c.alias("c"), i.alias("i")))
            return F.aggregate(at, F.array(F.lit(0)), lambda acc, x: step(acc, x["c"], x["i"]))

        zero = F.transform(F.concat(F.array(F.lit("")), both["b"]), lambda _: F.lit(0))
        return F.element_at(F.aggregate(both["a"], zero, row), -1)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), table))


def ratio(a: Column, b: Column) -> Column:
    """200 x common subsequence / both lengths, after lower-casing and with other characters than letters and digits as spaces."""
    return let(F.struct(normal(a).alias("x"), normal(b).alias("y")), lambda n: ratio_of_normal(n["x"], n["y"]))


def ratio_of_normal(x: Column, y: Column) -> Column:
    return F.when(F.length(x) + F.length(y) == 0, 0.0).otherwise(200.0 * common_subsequence(x, y) / (F.length(x) + F.length(y)))


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only for pairs whose ratio is below ``least``: the edit distance is never more than the letters that are not shared."""
    x, y = normal(a), normal(b)
    return F.levenshtein(x, y) <= (1 - least / 100) * (F.length(x) + F.length(y))
