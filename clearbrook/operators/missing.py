"""Missing values."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.names import unused
from clearbrook.operators.stats import ColumnStats, classify, column_stats, exact_quantiles, kind_of, most_frequent

#: Rows that a forest is fitted on lie in tasks of so many: a row is held with its weight in every tree and read again for each level, whatever few bytes it has in the table.
FOREST_ROWS = 32_768
METHODS = {"auto": "auto", "fill_median": "median", "median": "median", "fill_mode": "mode", "mode": "mode", "mean": "mean", "remove": "remove", "drop": "remove"}


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [c for c in df.columns if df.schema[c].dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df


def handle_missing(df: DataFrame, method: str = "auto") -> DataFrame:
    """auto: median of numbers, else the most frequent value (of equal ones the smallest), else ``Unknown``; median, mean, mode or remove."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    df, method = nan_to_null(df), METHODS[method]
    if method == "remove":
        return df.dropna()
    numbers = [c for c in df.columns if kind_of(df, c) == "number"]
    others = [c for c in df.columns if kind_of(df, c) != "number"]
    r = df.agg(F.count("*").alias("rows"), *[F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)], *[F.avg(f"`{c}`").alias(f"v{c}") for c in numbers if method == "mean"]).first()
    lacking = {c for i, c in enumerate(df.columns) if r[f"k{i}"] < r["rows"]}
    numbers, others = ([c for c in cs if c in lacking] for cs in (numbers, others))
    if method in ("median", "auto"):
        fill = {c: q[0] for c, q in zip(numbers, exact_quantiles(df, [F.col(f"`{c}`") for c in numbers], [0.5]), strict=True)}
    elif method == "mean":
        fill = {c: r[f"v{c}"] for c in numbers}
    else:
        known = most_frequent(df, numbers)
        fill = {c: known.get(c, 0) for c in numbers}
    if method in ("auto", "mode"):
        known = most_frequent(df, others)
        fill |= {c: known.get(c, "Unknown" if kind_of(df, c) == "string" else None) for c in others}
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in fill.items() if v is not None})


def impute_with_audit(df: DataFrame, stats: dict[str, ColumnStats] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned, flags). Numbers lacking up to 30 % get the median, others under 2 % lose those rows, else ``Unknown`` (dates stay null); filled columns get ``<c>_was_missing``. Numbers lacking more are flagged and kept."""
    df = nan_to_null(df)
    stats = column_stats(df, distinct=True, rates=True, quantiles=False) if stats is None else stats
    roles, drop, new, flags = classify(df, stats), [], {}, []
    lacking = [c for c, s in stats.items() if s.nulls and roles.get(c) == "numeric" and s.missing <= 0.30]
    medians = dict(zip(lacking, (q[0] for q in exact_quantiles(df, [F.col(f"`{c}`") for c in lacking], [0.5])), strict=True))
    for c, s in stats.items():
        if not s.nulls or c not in roles:
            continue
        x = F.col(f"`{c}`")
        if roles[c] == "numeric":
            if medians.get(c) is not None:
                new |= {f"{c}_was_missing": x.isNull(), c: F.coalesce(x, F.lit(medians[c]))}
            else:
                flags.append((c, "more than 30 % missing", s.nulls, s.missing))
        elif s.missing < 0.02:
            drop.append(c)
        elif roles[c] == "date" or s.kind != "string":
            new[f"{c}_was_missing"] = x.isNull()
        else:
            new |= {f"{c}_was_missing": x.isNull(), c: F.coalesce(x, F.lit("Unknown"))}
    out = df.dropna(subset=drop) if drop else df
    return out.withColumns(new) if new else out, df.sparkSession.createDataFrame(flags, "column string, reason string, count long, pct double")


def drop_high_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns lacking more than ``threshold`` go."""
    return df.drop(*[c for c, s in column_stats(df, quantiles=False).items() if s.missing > threshold])


def drop_low_missing_rows(df: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Rows without a value in a non-numeric column that lacks less than ``threshold``."""
    few = [c for c, s in column_stats(df, quantiles=False).items() if s.kind != "number" and 0 < s.missing < threshold]
    return df.dropna(subset=few) if few else df


def drop_high_missing_rows(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows that lack more than the share ``threshold`` of their columns."""
    return df.dropna(thresh=max(1, round(len(df.columns) * (1 - threshold))))


def model_impute(df: DataFrame, target: str, trees: int = 80, seed: int = 42, least: int = 20) -> DataFrame:
    """Nulls of ``target`` predicted from the other columns (strings by index, nulls as 0) by a random forest; with fewer than ``least`` known rows by median or mode."""
    df = nan_to_null(df)
    whole = df.schema[target].dataType
    known = df.where(F.col(target).isNotNull())
    if (rows := known.count()) < least:
        return _fill_one(df, target)
    features, work = [], df
    out, vector, label = unused(df.columns, "_p", "_features", "_label")
    for c in df.columns:
        if c == target:
            continue
        if kind_of(df, c) == "string":
            work = StringIndexer(inputCol=c, outputCol=(n := unused(work.columns, "_i")[0]), handleInvalid="keep").fit(work).transform(work).withMetadata(n, {})  # a number, however many values there are
            features.append(n)
        elif kind_of(df, c) == "number":
            (n,) = unused(work.columns, "_i")
            work = work.withColumn(n, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
            features.append(n)
    work = VectorAssembler(inputCols=features, outputCol=vector).transform(work)
    fitted = work.where(F.col(target).isNotNull())
    if rows > FOREST_ROWS:
        fitted = fitted.repartition(-(-rows // FOREST_ROWS))
    if kind_of(df, target) == "number":
        model = RandomForestRegressor(featuresCol=vector, labelCol=target, predictionCol=out, numTrees=trees, seed=seed).fit(fitted)
        filled = model.transform(work).withColumn(target, F.coalesce(F.col(target), F.col(out).cast(whole)))
    else:
        labels = StringIndexer(inputCol=target, outputCol=label).fit(known)
        model = RandomForestClassifier(featuresCol=vector, labelCol=label, predictionCol=out, numTrees=trees, seed=seed, maxBins=256).fit(labels.transform(fitted))
        names = F.array(*[F.lit(x) for x in labels.labels])
        filled = model.transform(work).withColumn(target, F.coalesce(F.col(target), F.get(names, F.col(out).cast("int"))))
    return filled.select(*df.columns)


def _fill_one(df: DataFrame, target: str) -> DataFrame:
    numeric = kind_of(df, target) == "number"
    v = exact_quantiles(df, [F.col(target)], [0.5])[0][0] if numeric else most_frequent(df, [target]).get(target)
    return df if v is None else df.withColumn(target, F.coalesce(F.col(target), F.lit(v).cast(df.schema[target].dataType)))
