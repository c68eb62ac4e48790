"""A similarity join of short strings: all pairs whose ratio reaches a bound, without comparing all pairs.

The ratio of two strings of lengths m and n with a common subsequence of length c is 200 c / (m + n). To reach t it
takes c >= t (m + n) / 200, so that the lengths are near, and at most 2 (m - c) + (n - c) of the m + 1 pairs of
neighbours (with a mark at both ends) of the first string are lost in the second: a character that goes loses two pairs, one that
comes in loses one. So at least two of the pairs are left, and enough for two strings alike to share two of the rarest of either: any two of these are
a key of the join. What meets there is held to the bound of lengths and edits, then verified.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.fuzzy import normal, ratio_of_normal
from clearbrook.functions.names import unused
from clearbrook.functions.text import let
from clearbrook.sources.staging import staged

#: Rows up to which a table counts as small enough to be sent to all tasks.
SMALL_ROWS = 100_000
#: Against rounding of the bounds.
TINY = 1e-9


def _keys(values: DataFrame) -> DataFrame:
    """(v, x, n, grams): a string, its normal form, that form's length and grams; the second gram of a kind counts as another one than the first."""
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i), lambda y: y == x)).cast("string")))
    own = let(normal(F.col("v")), lambda x: F.struct(x.alias("x"), F.length(x).alias("n"), let(let(F.concat(F.lit("\x02"), x, F.lit("\x03")), grams), numbered).alias("grams")))
    return staged(values.withColumn("own", own).select("v", "own.*"), "similar-keys")


def _prefix(keys: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """(v, x, n, gram): any two of the rarest grams of each string, so many of them that two are shared with any string that reaches the bound."""
    n, share = F.col("n"), least / 200
    short = F.ceil(n * share / (1 - share) - TINY)  # the length of the shortest string that can reach it
    kept = F.ceil(1 + (3 * share - 1) * (n + short) - TINY)  # grams that both have at least
    each = keys.select("v", "x", "n", F.explode("grams").alias("gram")).join(often, "gram")
    ordered = each.groupBy("v", "x", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    rarest = ordered.withColumn("grams", F.slice("grams", F.lit(1), (n + 3 - kept).cast("int"))["gram"])
    twos = F.flatten(F.transform("grams", lambda g, i: F.transform(F.slice("grams", i + 2, F.size("grams")), lambda h: F.concat(g, F.lit("\x05"), h))))
    return rarest.select("v", "x", "n", F.explode(twos).alias("gram"))


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): all pairs of a value of ``left`` and one of ``right`` (each with a column v of distinct strings) whose ratio is ``least`` or more.

    ``least`` is over 67. Strings without letters and digits are alike to none. Nulls have no partner; an empty table gives none.
    """
    if not 67 < least <= 100:
        raise ValueError("least must be over 67 and at most 100")
    keys = lambda x: _keys(x.where("v is not null").select("v")).where("n > 0")
    sides = [keys(left)] * 2 if left is right else [keys(left), keys(right)]
    often = sides[0].select("grams").unionByName(sides[1].select("grams")).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    a, b = (_prefix(s, often, least) for s in sides)
    b = b.withColumnsRenamed({"v": "w", "x": "y", "n": "m"})
    total = F.col("n") + F.col("m")
    common = F.ceil(total * least / 200 - TINY)
    met = a.join(b, "gram").where(F.least("n", "m") >= common).select(F.col("v").alias("a"), F.col("w").alias("b"), "x", "y", "n", "m", (total - 2 * common).cast("int").alias("most"))
    near_enough = met.withColumn("edits", F.levenshtein("x", "y")).where("edits <= most").dropDuplicates(["a", "b"])
    # Where only characters are lost on the way to the shorter one, it is the common subsequence.
    value = F.when(F.col("edits") == F.abs(F.col("n") - F.col("m")), 200.0 * F.least("n", "m") / total).otherwise(ratio_of_normal(F.col("x"), F.col("y")))
    return near_enough.withColumn("ratio", value).where(F.col("ratio") >= least - TINY).select("a", "b", "ratio")


def sent_if_small(df: DataFrame) -> DataFrame:
    """A written table as one to broadcast, if it has few rows; larger ones are joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def mapped(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``column`` of ``df`` by a table (v, out) of distinct values; values that it lacks stay."""
    key, out = unused(df.columns, "v", "out")
    table = sent_if_small(staged(values.select(F.col("v").alias(key), F.col("out").alias(out)), "mapped-values"))
    return df.join(table, F.col(f"`{column}`") == F.col(key), "left").withColumn(column, F.coalesce(out, F.col(f"`{column}`"))).drop(key, out)
