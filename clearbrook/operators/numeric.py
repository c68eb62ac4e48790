"""Numeric validation, outliers and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.dates import age_years, date_parts
from clearbrook.functions.names import unused
from clearbrook.functions.text import email_domain, word_count
from clearbrook.operators.stats import ColumnStats, classify, column_stats, exact_quantiles, kind_of, number
from clearbrook.sources.staging import staged

#: Plausible ranges of clinical measurements.
CLINICAL_RANGES = {"heart_rate": (40, 200), "systolic_bp": (70, 250), "diastolic_bp": (40, 150), "temperature": (35, 42), "spo2": (70, 100)}


def numbers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if kind_of(df, c) == "number"]


def fix_negatives(df: DataFrame, columns: list[str] | None = None, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Where at least 99 % of a column's values, but not all, are 0 or more, its negatives become the median of those."""
    columns = numbers(df) if columns is None else columns
    stats = column_stats(df, columns, quantiles=False) if stats is None else stats
    few = [c for c in columns if stats[c].positive is not None and 0.99 <= stats[c].positive < 1]
    medians = exact_quantiles(df, [F.when(number(c) >= 0, number(c)) for c in few], [0.5])
    new = {c: F.when(F.col(f"`{c}`") < 0, F.lit(m[0])).otherwise(F.col(f"`{c}`")) for c, m in zip(few, medians, strict=True)}
    return df.withColumns(new) if new else df


def outlier_report(df: DataFrame, k: float = 1.5, columns: list[str] | None = None) -> DataFrame:
    """A row for each column with spread and outliers: count, pct, bounds, least and greatest outlier."""
    columns = numbers(df) if columns is None else columns
    bounds = {c: b for c, s in column_stats(df, columns).items() if (b := s.bounds(k))}
    return df.agg(outlier_rows(bounds).alias("r")).select(F.inline("r")).where("outliers > 0")


OUTLIERS = "column string, outliers long, pct double, lower double, upper double, min_outlier double, max_outlier double"


def outlier_rows(bounds: dict[str, tuple[float, float]]) -> Column:
    """An aggregate: the array of a struct for each column, as in ``OUTLIERS``."""
    rows = []
    for c, (lo, hi) in bounds.items():
        x = F.col(f"`{c}`").cast("double")
        out = (x < lo) | (x > hi)
        rows.append(F.struct(F.lit(c).alias("column"), F.count_if(out).alias("outliers"), (100.0 * F.count_if(out) / F.count(F.lit(1))).alias("pct"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), F.min(F.when(out, x)).alias("min_outlier"), F.max(F.when(out, x)).alias("max_outlier")))
    return F.array(*rows) if rows else F.max(F.expr(f"cast(array() as array<struct<{OUTLIERS.replace(' ', ':').replace(',:', ',')}>>)"))


def handle_outliers(df: DataFrame, method: str = "cap", k: float = 1.5, columns: list[str] | None = None) -> DataFrame:
    """cap: values outside the bounds become the bound; remove: their rows go, nulls stay; ignore: nothing. Bounds are those of the input."""
    if method == "ignore":
        return df
    if method not in ("cap", "remove"):
        raise ValueError(f"unknown method {method!r}")
    columns = numbers(df) if columns is None else columns
    # Columns whose values all lie within their bounds stay as they are, type included.
    bounds = {c: b for c, s in column_stats(df, columns).items() if (b := s.bounds(k)) and (s.low < b[0] or s.high > b[1])}
    if method == "cap":
        return df.withColumns({c: F.least(F.greatest(F.col(f"`{c}`"), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in bounds.items()}) if bounds else df
    for c, (lo, hi) in bounds.items():
        df = df.where(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").between(lo, hi))
    return df


def clip_ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return handle_outliers(df, "cap", 3.0, columns)


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with <c>_z; null where a column has no spread, and for NaN."""
    stats = column_stats(df, columns, quantiles=False)
    return df.withColumns({f"{c}_z": F.try_divide(number(c) - F.lit(s.mean), F.lit(s.std)) for c, s in stats.items()})


def clinical_ranges(df: DataFrame) -> DataFrame:
    """(column, range, invalid): values outside the range of the first measurement that a column's name holds."""
    found = [(c, p) for c in numbers(df) for p in [next((p for p in CLINICAL_RANGES if p in c.lower()), None)] if p]
    if not found:
        return df.sparkSession.createDataFrame([], "column string, range string, invalid long")
    rows = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("range"), F.count_if(~F.col(f"`{c}`").between(*CLINICAL_RANGES[p])).alias("invalid")) for c, p in found]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def at_least(df: DataFrame, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(fixed, violations): for each (a, b) in turn, a below b becomes b. Names ignore case; rules on columns that aren't there are skipped."""
    names, out, counts = {c.lower(): c for c in df.columns}, df, []
    for a, b in rules:
        if a.lower() in names and b.lower() in names:
            x, y = F.col(f"`{names[a.lower()]}`"), F.col(f"`{names[b.lower()]}`")
            (n,) = unused(out.columns, "_v")
            out = out.withColumn(n, F.coalesce(x < y, F.lit(False))).withColumn(names[a.lower()], F.when(x < y, y).otherwise(x))
            counts.append((f"{a} < {b}", n))
    if not counts:
        return df, df.sparkSession.createDataFrame([], "rule string, violations long")
    rows = [F.struct(F.lit(rule).alias("rule"), F.count_if(n).alias("violations")) for rule, n in counts]
    return out.drop(*[n for _, n in counts]), out.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def equal_width(x: Column, low: float, high: float, bins: int = 5) -> Column:
    """Right-closed bins of equal width, numbered from 0; the lowest value is in the first."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((x - low) / ((high - low) / bins)).cast("int") - 1))


def dense_codes(values: DataFrame) -> DataFrame:
    """(v, code): the distinct values of a column v of ``values``, numbered from 0 in order, without a task that sees them all: values are dealt by ranges and written, ranges are counted, and a code is a value's place in its range after all values of the ranges before."""
    ranges = values.where("v is not null").distinct().repartitionByRange("v").sortWithinPartitions("v").select("v", F.spark_partition_id().alias("part"))
    ranges = staged(ranges, "value-ranges")
    sizes = sorted((r["part"], r["count"]) for r in ranges.groupBy("part").count().collect())
    before, at = [], 0
    for part, n in sizes:
        before.append((part, at))
        at += n
    offsets = values.sparkSession.createDataFrame(before, "part int, before long")
    placed = ranges.withColumn("place", F.expr("row_number() over (partition by part order by v)"))
    return placed.join(F.broadcast(offsets), "part").select("v", (F.col("before") + F.col("place") - 1).alias("code"))


def label_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``df`` with 0-based codes of the values in order (`dense_codes`); null is -1."""
    key, code = unused(df.columns, "_v", "_code")
    ranked = dense_codes(df.select(F.col(f"`{column}`").alias("v"))).select(F.col("v").alias(key), F.col("code").cast("int").alias(code))
    joined = df.join(ranked, F.col(f"`{column}`") == F.col(key), "left").drop(key)
    return joined.withColumn(out or f"{column}_encoded", F.coalesce(code, F.lit(-1))).drop(code)


def engineer_features(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Date parts and ages, mail domains, lengths and word counts, bins, logs of skewed columns and label codes, by column type."""
    stats, new, coded = column_stats(df, distinct=True, quantiles=False), {}, []
    holds_at = df.agg(*[F.max(F.col(f"`{c}`").contains("@")).alias(c) for c, s in stats.items() if s.kind == "string"] or [F.lit(None).alias("_")]).first()
    for c, s in stats.items():
        x = F.col(f"`{c}`")
        if s.kind == "date":
            new |= {k.replace("day_of_week", "dayofweek"): v for k, v in date_parts(x, c, None).items()}
            if "birth" in c.lower() or "dob" in c.lower():
                new[f"{c}_age"] = age_years(x, as_of if as_of is not None else F.current_date())
        elif s.kind == "string":
            new |= {f"{c}_length": F.length(x), f"{c}_word_count": word_count(x)}
            if holds_at[c]:
                new[f"{c}_domain"] = email_domain(x)
            if s.distinct and 2 <= s.distinct <= 10:
                coded.append(c)
        elif s.kind == "number":
            new |= _number_features(c, x, s)
    out = df.withColumns(new) if new else df
    for c in coded:
        out = label_codes(out, c)
    return out


def _number_features(c: str, x: Column, s: ColumnStats) -> dict[str, Column]:
    new = {}
    if s.distinct and s.distinct > 10:
        new[f"{c}_binned"] = equal_width(x, s.low, s.high)
    if s.low is not None and s.low > 0 and s.skew is not None and abs(s.skew) > 1:
        new[f"{c}_log"] = F.log1p(x)
    return new


def few_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with <c>_encoded of columns with few values (categories, of which there are under 50 each): places in the order of the values, null -1. One pass gives the values of all columns."""
    if not columns:
        return df
    values = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    code = lambda c, vs: F.coalesce((F.array_position(F.array(*[F.lit(v) for v in vs]), F.col(f"`{c}`")) - 1).cast("int"), F.lit(-1)) if vs else F.lit(-1)
    return df.withColumns({f"{c}_encoded": code(c, values[f"v{i}"]) for i, c in enumerate(columns)})


def role_features(df: DataFrame, roles: dict[str, str] | None = None, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Features by role: lengths of text, bins of numbers with over 10 values, codes of categories."""
    stats = column_stats(df, distinct=True, rates=roles is None, quantiles=False) if stats is None else stats
    roles = classify(df, stats) if roles is None else roles
    new = {}
    for c, role in roles.items():
        x = F.col(f"`{c}`")
        if role == "text":
            new |= {f"{c}_length": F.length(x), f"{c}_word_count": word_count(x)}
        elif role == "numeric" and (stats[c].distinct or 0) > 10:
            new[f"{c}_binned"] = F.coalesce(equal_width(x, stats[c].low, stats[c].high), F.lit(-1))
    return few_codes(df.withColumns(new) if new else df, [c for c, role in roles.items() if role == "categorical"])
