"""Aggregates and views behind charts and tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearbrook.operators.stats import MARGIN, exact_quantiles, kind_of

EMPTY = ["", "0", "nan", "None", "null"]


def chart_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Only ``columns``: dates as text, null numbers 0, other nulls empty."""
    columns = df.columns if columns is None else columns
    c = lambda n: F.col(f"`{n}`")
    return df.select(*[(F.coalesce(c(n), F.lit(0)) if kind_of(df, n) == "number" else F.coalesce(c(n).cast("string"), F.lit(""))).alias(n) for n in columns])


def group_aggregate(df: DataFrame, x: str, y: str, method: str = "mean") -> DataFrame:
    """(label, value) of count, sum, mean, median, min or max of y for each x as text; nulls of y are left out, a group of none is 0."""
    label = F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("null")).alias("label")
    if method == "median":
        return group_medians(df.select(label, F.col(f"`{y}`").cast("double").alias("v")))
    f = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}.get(method, F.avg)
    return df.groupBy(label).agg(F.coalesce(f(F.col(f"`{y}`")).cast("double"), F.lit(0.0)).alias("value"))


def group_medians(df: DataFrame) -> DataFrame:
    """(label, value) of a table (label, v): exact medians, 0 for a group without values.

    An approximate percentile brackets each median; only the distinct values in the bracket are ranked, with
    their counts. If a bracket should not hold the median, the group's values are ranked whole.
    """
    around = F.percentile_approx("v", [0.5 - MARGIN, 0.5 + MARGIN], 10_000)
    groups = df.groupBy("label").agg(F.count("v").alias("n"), around.alias("q")).select("label", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    met = df.where("v is not null").join(groups, "label")
    counts = met.groupBy("label").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("within"))
    ranges = groups.join(counts, "label", "left").withColumn("holds", (F.floor((F.col("n") - 1) / 2) >= F.col("below")) & (F.ceil((F.col("n") - 1) / 2) < F.col("below") + F.col("within")))
    ranges = ranges.withColumn("below", F.when(F.col("holds"), F.col("below")).otherwise(0))
    values = df.where("v is not null").join(ranges.where("n > 0"), "label").where("not holds or v between lo and hi").groupBy("label", "v", "n", "below").count()
    upto = F.col("below") + F.sum("count").over(Window.partitionBy("label").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = values.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("count"))
    has = lambda k: (F.col("start") <= k) & (k < F.col("upto"))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    medians = placed.where(has(low) | has(high)).groupBy("label").agg((0.5 * F.min("v") + 0.5 * F.max("v")).alias("value"))
    return groups.select("label").join(medians, "label", "left").select("label", F.coalesce("value", F.lit(0.0)).alias("value"))


def correlations(df: DataFrame, columns: list[str], pairwise: bool = False) -> DataFrame:
    """(a, b, r) of all pairs of number columns, from one pass. Nulls are 0 unless ``pairwise``; no variance gives 0."""
    v = lambda c: F.col(f"`{c}`").cast("double") if pairwise else F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(F.corr(v(a), v(b)), F.lit(0.0)), F.lit(0.0)).alias("r")) for a, b in combinations(columns, 2)]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins over the range; empty bins have no row."""
    x = F.col(f"`{column}`").cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, w = r["lo"] or 0.0, ((r["hi"] or 0.0) - (r["lo"] or 0.0)) / bins
    at = F.least(F.lit(bins - 1), F.floor((x - lo) / w).cast("int")) if w else F.lit(0)
    return df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(lo) + F.col("bin") * w).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * w).alias("high"), "n")


def box_stats(df: DataFrame, x: str, y: str, groups: int = 20) -> DataFrame:
    """(label, min, q1, median, q3, max, mean) of y for the first ``groups`` values of x."""
    t = df.select(F.col(f"`{x}`").cast("string").alias("label"), F.col(f"`{y}`").cast("double").alias("v"))
    first = t.groupBy("label").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean")).orderBy("label").limit(groups).collect()
    quartiles = exact_quantiles(t, [F.when(F.col("label").eqNullSafe(r["label"]), F.col("v")) for r in first], [0.25, 0.5, 0.75])
    rows = [(r["label"], r["min"], *q, r["max"], r["mean"]) for r, q in zip(first, quartiles, strict=True)]
    return df.sparkSession.createDataFrame(rows, "label string, min double, q1 double, median double, q3 double, max double, mean double")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 15, clip: int = 27) -> DataFrame:
    """The ``k`` most frequent values, of equal ones the first by name; empty ones left out, labels clipped."""
    t = value_counts(df.where(F.col(f"`{column}`").isNotNull() & ~F.col(f"`{column}`").cast("string").isin(*EMPTY)), column)
    return t.orderBy(F.desc("n"), "value").limit(k).select(F.substring("value", 1, clip).alias("label"), "n")


def cross_filter(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Rows whose columns, as text, equal the chosen values."""
    return df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").cast("string") == v for c, v in chosen.items()], F.lit(True)))


def search_any(df: DataFrame, text: str) -> DataFrame:
    """Rows of which some column holds ``text``, ignoring case."""
    hits = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(text.lower()), F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def quality_class(value: Column, score: Column) -> Column:
    return F.when(value.isNull() | (value.cast("string") == ""), "missing").when(score >= 80, "good").when(score >= 60, "warning").otherwise("poor")


def clip_text(x: Column, n: int) -> Column:
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
