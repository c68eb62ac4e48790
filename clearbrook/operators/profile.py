"""Profiles: overview, nulls, issues, quality scores, recommendations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.text import number_of
from clearbrook.operators.dedup import duplicate_count
from clearbrook.operators.numeric import numbers
from clearbrook.operators.stats import classify, column_stats, exact_quantiles, kind_of, missing, number

DATE_SHAPES = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4}|(?i:\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2})"
#: Name parts that tell healthcare data.
MEDICAL_NAMES = ["patient", "diagnosis", "icd", "mrn", "hospital", "physician", "medical", "clinical"]


def _strings(df: DataFrame) -> list[str]:
    return [c for c in df.columns if kind_of(df, c) == "string"]


def _rows(df: DataFrame, structs: list[Column], schema: str) -> DataFrame:
    """One aggregate row turned into a row for each struct."""
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r")) if structs else df.sparkSession.createDataFrame([], schema)


def overview(df: DataFrame) -> DataFrame:
    kinds = [t for _, t in df.dtypes]
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(kinds)).alias("columns"), (F.col("rows") * len(kinds)).alias("cells"), *[F.lit(kinds.count(t)).alias(f"n_{t.split('(')[0]}") for t in sorted(set(kinds))])


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, pct) of every column from one pass."""
    return _rows(df, [F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("nulls"), F.coalesce(F.try_divide(100.0 * F.count_if(missing(df, c)), F.count("*")), F.lit(0.0)).alias("pct")) for c in df.columns], "column string, nulls long, pct double")


def column_metadata(df: DataFrame) -> DataFrame:
    """(column, dtype, kind, distinct, nulls, non_nulls). Values are counted by a grouped aggregate for each column, which reads that column only; no row is repeated for each column."""
    out = df.sparkSession.createDataFrame([], "column string, dtype string, kind string, distinct long, nulls long, non_nulls long")
    for c, t in df.dtypes:
        counts = df.groupBy(F.col(f"`{c}`").alias("v")).count()
        sums = counts.agg(F.count("v").alias("distinct"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("count"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("count"))), F.lit(0)).alias("non_nulls"))
        out = out.unionByName(sums.select(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.lit(kind_of(df, c)).alias("kind"), "distinct", "nulls", "non_nulls"))
    return out


def role_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(classify(df).items()), "column string, role string")


def categorical_samples(df: DataFrame, n: int = 10) -> DataFrame:
    """Up to ``n`` smallest values of each categorical column."""
    found = [c for c, r in classify(df).items() if r == "categorical"]
    return _rows(df, [F.struct(F.lit(c).alias("column"), F.slice(F.sort_array(F.collect_set(F.col(f"`{c}`").cast("string"))), 1, n).alias("values")) for c in found], "column string, values array<string>")


def detectors(df: DataFrame) -> DataFrame:
    """For each string column: formatted numbers, date shapes, mixed types, special characters."""

    def row(c: str) -> Column:
        x = F.col(f"`{c}`")
        some = lambda p: F.coalesce(F.max(p), F.lit(False))
        return F.struct(F.lit(c).alias("column"), some(x.rlike("[,$%]")).alias("formatted_numbers"), some(x.rlike(DATE_SHAPES)).alias("dates"), ((F.count_if(number_of(x).isNotNull()) > 0) & (F.count_if(x.isNotNull() & number_of(x).isNull()) > 0)).alias("mixed"), some(x.rlike(r"(?U)[^\w\s]")).alias("special_characters"))

    return _rows(df, [row(c) for c in _strings(df)], "column string, formatted_numbers boolean, dates boolean, mixed boolean, special_characters boolean")


@dataclass
class Profile:
    """What the rules below need, from two aggregate jobs and the duplicate count."""

    rows: int
    columns: int
    missing: dict[str, int]
    duplicates: int
    mixed: list[str]
    formatted: list[str]
    dates: list[str]
    far: dict[str, int]
    farther: dict[str, int]
    beyond: dict[str, int]
    special: list[str]


def profile(df: DataFrame) -> Profile:
    stats = column_stats(df)
    found = {r["column"]: r for r in detectors(df).collect()}
    aggs, nums = [F.count("*").alias("_n")], numbers(df)
    for i, c in enumerate(nums):
        x, s = F.col(f"`{c}`").cast("double"), stats[c]
        for k, name in ((1.5, "a"), (3.0, "b")):
            b = s.bounds(k)
            aggs.append((F.count_if((x < b[0]) | (x > b[1])) if b else F.lit(0)).alias(f"{name}{i}"))
        aggs.append((F.count_if(F.abs((x - s.mean) / s.std) > 3) if s.std else F.lit(0)).alias(f"z{i}"))
    r = df.agg(*aggs).first()
    dup = duplicate_count(df).first()
    return Profile(r["_n"], len(df.columns), {c: s.nulls for c, s in stats.items()}, dup["duplicate_rows"], [c for c, x in found.items() if x["mixed"]], [c for c, x in found.items() if x["formatted_numbers"]], [c for c, x in found.items() if x["dates"]], {c: r[f"a{i}"] for i, c in enumerate(nums)}, {c: r[f"b{i}"] for i, c in enumerate(nums)}, {c: r[f"z{i}"] for i, c in enumerate(nums)}, [c for c, x in found.items() if x["special_characters"]])


def quality_issues(df: DataFrame) -> DataFrame:
    """A row for each issue: kind, column (null for the table), count, pct of rows, and what the combined issues of a column are."""
    p = profile(df)
    pct = lambda n: 100.0 * n / p.rows if p.rows else 0.0
    rows = [("formatted_numbers", c, None, None, None) for c in p.formatted] + [("date_strings", c, None, None, None) for c in p.dates] + [("mixed_types", c, None, None, None) for c in p.mixed]
    cells = sum(p.missing.values())
    rows += [("missing_cells", None, cells, None, None)] if cells else []
    rows += [("missing", c, n, pct(n), None) for c, n in p.missing.items() if n] + [("outliers", c, n, pct(n), None) for c, n in p.far.items() if n]
    rows += [("duplicates", None, p.duplicates, pct(p.duplicates), None)] if p.duplicates else []
    parts = (("special characters", p.special), ("formatted numbers", p.formatted), ("date strings", p.dates))
    rows += [("column_issues", c, None, None, ", ".join(held)) for c in df.columns if (held := [name for name, columns in parts if c in columns])]
    return df.sparkSession.createDataFrame(rows, "issue string, column string, n long, pct double, details string")


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first ``rows`` rows, as they come."""
    return df.limit(rows)


def column_quality(df: DataFrame) -> DataFrame:
    """(column, score): max(0, ((100 - missing %) + consistency) / 2 - min(2 x outlier %, 30)); consistency is 50 for mixed columns, outliers lie beyond three deviations."""
    p = profile(df)
    pct = lambda n: 100.0 * n / p.rows if p.rows else 0.0
    return df.sparkSession.createDataFrame([(c, max(0.0, ((100 - pct(n)) + (50 if c in p.mixed else 100)) / 2 - min(2 * pct(p.beyond.get(c, 0)), 30))) for c, n in p.missing.items()], "column string, score double")


def quality_score(df: DataFrame) -> DataFrame:
    """completeness 0.25, consistency 0.20, validity 0.20, uniqueness 0.15 and accuracy 0.20, each rounded to one decimal first."""
    p = profile(df)
    cells, nums = p.rows * p.columns, max(1, len(p.far) * p.rows)
    share = lambda bad, of: round(100 * (1 - bad / of), 1) if of else 100.0
    c = share(sum(p.missing.values()), cells), share(len(p.mixed), p.columns), share(sum(p.farther.values()), nums), share(p.duplicates, p.rows), share(sum(p.beyond.values()), nums)
    return df.sparkSession.createDataFrame([(*c, round(c[0] * 0.25 + c[1] * 0.2 + c[2] * 0.2 + c[3] * 0.15 + c[4] * 0.2, 1))], "completeness double, consistency double, validity double, uniqueness double, accuracy double, overall double")


def cleaning_score(df: DataFrame) -> DataFrame:
    """completeness x 0.6 + consistency x 0.4, consistency being 100 - 50 x the share of duplicate rows."""
    nulls = sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0))
    a = df.agg(F.count("*").alias("n"), nulls.alias("nulls"))
    both = a.join(duplicate_count(df).select(F.col("rows").alias("n"), "duplicate_rows"), "n")
    complete = F.coalesce(F.try_divide(100.0 * (F.col("n") * len(df.columns) - F.col("nulls")), F.col("n") * len(df.columns)), F.lit(100.0))
    consistent = 100 - F.coalesce(F.try_divide(50.0 * F.col("duplicate_rows"), F.col("n")), F.lit(0.0))
    return both.select(complete.alias("completeness"), consistent.alias("consistency"), (complete * 0.6 + consistent * 0.4).alias("overall"))


def recommendations(df: DataFrame) -> DataFrame:
    """(priority, operation, columns, reason, confidence), one row for each rule that fits, the most urgent first. Rules on letter case look at all string columns and values."""
    p, rows = profile(df), []
    cells = p.rows * p.columns
    missing = 100.0 * sum(p.missing.values()) / cells if cells else 0.0
    lacking = [c for c, n in p.missing.items() if n]
    if missing > 20:
        rows += [("HIGH", "handle_missing", lacking, f"{missing:.1f} % of all cells are missing", 0.95), ("MEDIUM", "ml_impute_missing", lacking, "predictions keep relations between columns", 0.82)]
    elif missing > 5:
        rows.append(("MEDIUM", "handle_missing", lacking, f"{missing:.1f} % of all cells are missing", 0.90))
    if p.duplicates:
        rows.append(("HIGH" if p.duplicates > 0.05 * p.rows else "MEDIUM", "remove_duplicates", [], f"{p.duplicates} duplicate rows", 1.0))
    medical = [c for c in df.columns if any(w in c.lower() for w in MEDICAL_NAMES)]
    if medical or any(w in " ".join(df.columns).lower() for w in MEDICAL_NAMES):
        rows += [("HIGH", "redact_phi", medical, "healthcare data", 0.85), ("MEDIUM", "standardize_codes", medical, "healthcare data", 0.90)]
    beyond = [c for c, n in p.beyond.items() if n]
    if sum(p.beyond.values()) > 0.05 * p.rows:
        rows.append(("MEDIUM", "handle_outliers", beyond, f"{sum(p.beyond.values())} outliers", 0.75))
    strings = _strings(df)
    cased = df.agg(*[_mixed_case(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(strings)]).first() if strings else []
    uneven = [c for i, c in enumerate(strings) if cased[f"c{i}"]]
    if uneven:
        rows.append(("LOW", "clean_text", uneven, "inconsistent letter case", 0.80))
    if p.mixed:
        rows.append(("HIGH", "smart_type_conversion", p.mixed, "mixed types", 0.88))
    high = [c for c, n in p.missing.items() if n > 0.5 * p.rows]
    if high:
        rows.append(("MEDIUM", "remove_high_missing", high, "over 50 % missing", 0.70))
    out = df.sparkSession.createDataFrame(rows, "priority string, operation string, columns array<string>, reason string, confidence double")
    return out.orderBy(F.expr("CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"), F.desc("confidence"), "operation")


def _mixed_case(x: Column) -> Column:
    """Whether a column has values all in capitals and values all in small letters, or several words in mixed case."""
    low, up = F.lower(x), F.upper(x)
    upper, lower = (x == up) & (x != low), (x == low) & (x != up)
    mixed = x.contains(" ") & (x != low) & (x != up)
    return F.coalesce((F.max(upper) & F.max(lower)) | F.max(mixed), F.lit(False))


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row for a number column; the ten most frequent values of any other."""
    x = F.col(f"`{column}`")
    if kind_of(df, column) == "number":
        r = lambda c, n: F.round(c.cast("double"), 4).alias(n)
        x = number(column)
        median = F.lit(exact_quantiles(df, [x], [0.5])[0][0]).cast("double")
        return df.agg(F.count(x).alias("count"), F.count_if(x.isNull()).alias("nulls"), r(F.avg(x), "mean"), r(median, "median"), r(F.stddev_samp(x), "std"), r(F.min(x), "min"), r(F.max(x), "max"))
    return df.where(x.isNotNull()).groupBy(x.cast("string").alias("value")).count().orderBy(F.desc("count"), "value").limit(10)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table, rows, columns, missing_cells, duplicate_rows) of both tables."""

    def one(name: str, df: DataFrame) -> DataFrame:
        nulls = sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0))
        return df.agg(nulls.cast("long").alias("missing_cells"), F.count("*").alias("rows")).join(duplicate_count(df), "rows").select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "missing_cells", "duplicate_rows")

    return one("before", before).unionByName(one("after", after))


def compare_samples(before: DataFrame, after: DataFrame, rows: int = 25) -> DataFrame:
    """(table, row): up to ``rows`` rows of both tables as JSON text, nulls included."""
    text = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    one = lambda name, df: df.limit(rows).select(F.lit(name).alias("table"), text(df).alias("row"))
    return one("before", before).unionByName(one("after", after))


def inspection(df: DataFrame) -> dict[str, DataFrame]:
    """All that is looked at before a table is cleaned: overview, roles, nulls, metadata, samples of categories and duplicates, each a table."""
    return {"overview": overview(df), "roles": role_table(df), "nulls": null_profile(df), "columns": column_metadata(df), "samples": categorical_samples(df), "duplicates": duplicate_count(df)}


def unexplained_nulls(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Columns with nulls that ``flags`` doesn't name."""
    return null_profile(df).where("nulls > 0").join(flags.select("column").distinct(), "column", "left_anti")


def feature_suggestions(df: DataFrame) -> list[str]:
    """Names of features worth deriving, by the columns there are."""
    p, strings = profile(df), _strings(df)
    found = ["date parts"] * bool(p.dates) + ["scaling"] * bool(numbers(df)) + ["one-hot encoding"] * (len(strings) > 2)
    return found or ["schema alignment"]


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change, change_pct) of rows, columns, missing cells, duplicate rows and the overall score; pct is of the value before, null where that is 0."""
    both = compare(before, after)
    scores = cleaning_score(before).select(F.lit("before").alias("table"), "overall").unionByName(cleaning_score(after).select(F.lit("after").alias("table"), "overall"))
    wide = both.join(scores, "table").groupBy().pivot("table", ["before", "after"]).agg(*[F.first(F.col(c).cast("double")).alias(c) for c in ("rows", "columns", "missing_cells", "duplicate_rows", "overall")])
    of = lambda c: F.struct(F.lit(c).alias("metric"), F.col(f"before_{c}").alias("before"), F.col(f"after_{c}").alias("after"))
    rows = wide.select(F.inline(F.array(*[of(c) for c in ("rows", "columns", "missing_cells", "duplicate_rows", "overall")])))
    return rows.withColumn("change", F.col("after") - F.col("before")).withColumn("change_pct", F.try_divide(100.0 * F.col("change"), F.col("before")))


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in before.columns]
