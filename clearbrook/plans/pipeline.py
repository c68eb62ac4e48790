"""Pipelines: a list of operations applied in turn, presets, lineage and summaries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clearbrook.functions.text import fold_replaced
from clearbrook.functions.values import SPELLING_FIXES, WORD_ABBREVIATIONS
from clearbrook.operators.categories import clean_text_columns, code_report, normalise_clinical_text, standardise_categories, standardise_codes
from clearbrook.operators.dedup import drop_exact, duplicate_count, near_duplicate_rows
from clearbrook.operators.missing import drop_high_missing, drop_high_missing_rows, handle_missing, impute_with_audit, model_impute
from clearbrook.operators.numeric import OUTLIERS, at_least, clinical_ranges, clip_ranges, engineer_features, fix_negatives, handle_outliers, outlier_report, outlier_rows, role_features
from clearbrook.operators.privacy import column_redactions, redact_columns
from clearbrook.operators.profile import cleaning_score, compare, recommendations
from clearbrook.operators.stats import classify, column_stats, kind_of, staged_with_stats
from clearbrook.operators.types import convert_types, parse_date_columns
from clearbrook.sources.staging import staged

Spec = dict[str, dict]


def _model_impute_all(df: DataFrame) -> DataFrame:
    for c, s in column_stats(df, quantiles=False).items():
        if s.nulls and s.kind in ("number", "string"):
            df = model_impute(df, c)
    return df


def _reported(df: DataFrame) -> DataFrame:
    clinical_ranges(df)  # a report only: rows stay as they are
    return df


OPERATIONS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "smart_type_conversion": lambda df, p: convert_types(df),
    "handle_missing": lambda df, p: handle_missing(df, p.get("method", "auto")),
    "ml_impute_missing": lambda df, p: _model_impute_all(df),
    "remove_duplicates": lambda df, p: drop_exact(df),
    "feature_engineering": lambda df, p: engineer_features(df),
    "clean_text": lambda df, p: clean_text_columns(df),
    "handle_outliers": lambda df, p: handle_outliers(df, p.get("method", "cap")),
    "remove_high_missing": lambda df, p: drop_high_missing(df, p.get("threshold", 0.5)),
    "drop_high_missing_rows": lambda df, p: drop_high_missing_rows(df, p.get("threshold", 0.5)),
    "redact_phi": lambda df, p: redact_columns(df),
    "validate_clinical": lambda df, p: _reported(df),
    "standardize_codes": lambda df, p: standardise_codes(df),
    "standardize_medical": lambda df, p: standardise_codes(df),
    "validate_ranges": lambda df, p: clip_ranges(df),
    "normalize_clinical_text": lambda df, p: normalise_clinical_text(df),
}
ORDER = ["smart_type_conversion", "handle_missing", "ml_impute_missing", "remove_duplicates", "feature_engineering", "clean_text", "handle_outliers", "remove_high_missing", "redact_phi", "validate_clinical", "standardize_codes", "normalize_clinical_text", "validate_ranges"]
BASE: Spec = {"smart_type_conversion": {}, "handle_missing": {"method": "auto"}, "remove_duplicates": {}, "feature_engineering": {}, "clean_text": {}, "handle_outliers": {"method": "cap"}}
PRESETS: dict[str, Spec] = {
    "auto_smart": BASE,
    "aggressive": BASE | {"ml_impute_missing": {}, "validate_ranges": {}, "remove_high_missing": {"threshold": 0.5}},
    "conservative": {"smart_type_conversion": {}, "remove_duplicates": {}},
    "healthcare_specific": BASE | {"ml_impute_missing": {}, "redact_phi": {}, "validate_clinical": {}, "standardize_codes": {}, "normalize_clinical_text": {}, "validate_ranges": {}},
}


def run_operations(df: DataFrame, spec: Spec, order: list[str] | None = None, lineage: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(cleaned, lineage). The operations of ``spec`` in ``order``; unknown names are skipped. With ``lineage`` the result of each step is written once to the shared folder and counted from there."""
    steps, rows, spark = [s for s in order or ORDER if s in spec and s in OPERATIONS], [], df.sparkSession
    now = _state(df) if lineage else None
    for i, name in enumerate(steps, 1):
        df = OPERATIONS[name](df, spec[name])
        if lineage:
            df = staged(df, f"step-{i}")
            was, now = now, _state(df)
            rows.append((i, name, was[0], now[0], was[1], now[1], was[2], now[2], was[3], now[3], abs(was[0] - now[0]), max(0, was[2] - now[2])))
    schema = "step int, operation string, rows_before long, rows_after long, columns_before int, columns_after int, missing_before long, missing_after long, duplicates_before long, duplicates_after long, rows_affected long, missing_reduced long"
    return df, spark.createDataFrame(rows, schema) if lineage else None


def _state(df: DataFrame) -> tuple[int, int, int, int]:
    r = df.agg(F.count("*").alias("n"), sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).alias("m")).first()
    return r["n"], len(df.columns), r["m"], duplicate_count(df).first()["duplicate_rows"]


RULES = [("confirmed", "deaths"), ("confirmed", "recovered")]


class AutoCleaned(NamedTuple):
    """The cleaned table and the tables of its report."""

    cleaned: DataFrame
    flags: DataFrame
    audit: DataFrame
    outliers: DataFrame
    violations: DataFrame
    duplicates: DataFrame
    near_duplicates: DataFrame
    log: DataFrame


def auto_clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned, flags) of ``auto_clean_reports``."""
    done = auto_clean_reports(df)
    return done.cleaned, done.flags


def auto_clean_reports(df: DataFrame) -> AutoCleaned:
    """The seven fixed steps: missing values, dates, categories, numbers (negatives and rules fixed, outliers reported), duplicates (exact ones go, near ones are reported), features.

    The table is written after the steps that later ones take statistics of, and these, with what the report counts, are observed
    on the rows as they are written: roles are found anew without a pass of their own. audit: (column, nulls, action,
    remaining) of every input column; log: (step, category, column, metric, value) of what each step did.
    """
    spark, given = df.sparkSession, df
    before = column_stats(df, distinct=True, rates=True, quantiles=False)
    roles_in = classify(df, before)
    df, flags = impute_with_audit(df, before)
    flagged, log = {r["column"] for r in flags.collect()}, []
    filled = {c for c in given.columns if f"{c}_was_missing" in df.columns}
    for c, s in before.items():
        if s.nulls and c not in flagged:
            log.append(("missing values", c, "filled" if c in filled else "rows dropped", float(s.nulls)))
    stats = before
    if any(s.nulls for s in before.values()):
        df, stats = staged_with_stats(df, "imputed")
    roles = classify(df, stats)
    dated = parse_date_columns(df, roles)
    log += [("dates", c, "parsed", 1.0) for c, r in roles.items() if r == "date"]
    if dated is not df:
        df, stats = staged_with_stats(dated, "dated")
        roles = classify(df, stats)
    df = standardise_categories(df, roles)
    log += [("categories", c, "standardised", 1.0) for c, r in roles.items() if r in ("categorical", "text")]
    # What has been done to strings changes no role of a number.
    numeric = [c for c, r in roles.items() if r == "numeric"]
    df = staged(fix_negatives(df, numeric, stats), "standardised")
    bounds = {c: x for c, s in column_stats(df, numeric).items() if (x := s.bounds(1.5))}
    fixed, violations = at_least(df, RULES)
    seen = Observation()
    df, stats = staged_with_stats(drop_exact(fixed.observe(seen, F.count(F.lit(1)).alias("rows"), *([outlier_rows(bounds).alias("outliers")] if bounds else []))), "deduplicated")
    outliers = spark.createDataFrame([tuple(r) for r in seen.get.get("outliers", []) if r["outliers"]], OUTLIERS)
    log += [("numbers", r["column"], "outliers", float(r["outliers"])) for r in seen.get.get("outliers", []) if r["outliers"]]
    log += [("numbers", r["rule"], "violations fixed", float(r["violations"])) for r in violations.collect() if r["violations"]]
    rows = next(iter(stats.values())).rows
    dropped = seen.get["rows"] - rows
    duplicates = spark.createDataFrame([(seen.get["rows"], dropped)], "rows long, duplicate_rows long")
    log.append(("duplicates", None, "exact rows dropped", float(dropped)))
    roles = classify(df, stats)
    keys = [c for c, r in roles.items() if r in ("date", "categorical")]
    if keys and len(keys) < len(df.columns):
        near = near_duplicate_rows(df, keys).where("near_duplicate").drop("near_duplicate")
        again = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1").agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        log.append(("duplicates", ", ".join(keys), "near-duplicate rows", float(again)))
    else:
        near = df.limit(0)
    out = role_features(df, roles, stats)
    log += [("features", c, "added", 1.0) for c in out.columns if c not in df.columns]
    left = {c: s.nulls for c, s in stats.items()}

    def action(c: str) -> str:
        if not before[c].nulls:
            return "none"
        if c in flagged:
            return "flagged"
        if c not in filled:
            return "rows dropped"
        return "median" if roles_in.get(c) == "numeric" else "Unknown" if before[c].kind == "string" and roles_in.get(c) != "date" else "left null"

    audit = spark.createDataFrame([(c, before[c].nulls, action(c), left.get(c, 0)) for c in given.columns], "column string, nulls long, action string, remaining long")
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(log, 1)], "step int, category string, column string, metric string, value double")
    return AutoCleaned(out, flags, audit, outliers, violations, duplicates, near, table)


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of both tables, row reduction, column change and the three-part scores."""
    both = compare(before, after)
    a, b = cleaning_score(before).select(F.lit("before").alias("table"), F.col("overall").alias("score")), cleaning_score(after).select(F.lit("after").alias("table"), F.col("overall").alias("score"))
    return both.join(a.unionByName(b), "table")


def apply_recommendations(df: DataFrame, priority: str = "HIGH") -> tuple[DataFrame, Spec]:
    """(cleaned, spec): the operations recommended with ``priority``."""
    names = {r["operation"] for r in recommendations(df).where(F.col("priority") == priority).select("operation").distinct().collect()}
    spec: Spec = {n: {} for n in ORDER if n in names}
    return run_operations(df, spec)[0], spec


def validation_report(df: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """(category, metric, value): what a cleaning run has to do with a table, as rows: identifiers, conversions, missing values, duplicates, codes, text, outliers, ranges and the overall score (of ``after`` as well, if given)."""
    spark = df.sparkSession
    converted = convert_types(df)
    kinds = [(kind_of(converted, c), c) for c in df.columns if kind_of(df, c) == "string" and kind_of(converted, c) != "string"]
    rows = [("type_conversions", f"{k}_columns", float(sum(x == k for x, _ in kinds))) for k in ("date", "number")]
    out = spark.createDataFrame(rows, "category string, metric string, value double")
    sums = [F.lit(0.0) + sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))]
    strings = [c for c in df.columns if kind_of(df, c) == "string"]
    words = lambda table: sum((F.coalesce(F.sum(fold_replaced(F.col(f"`{c}`"), table, True)["n"]), F.lit(0)) for c in strings), F.lit(0))
    names = [("missing", "cells"), ("text", "abbreviations"), ("text", "misspellings")]
    sums += [words(WORD_ABBREVIATIONS), words(SPELLING_FIXES)]
    counted = df.agg(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for (c, m), v in zip(names, sums, strict=True)]).alias("r")).select(F.inline("r"))
    part = lambda d, category, metric, value: d.select(F.lit(category).alias("category"), metric.alias("metric"), value.cast("double").alias("value"))
    out = out.unionByName(counted)
    out = out.unionByName(part(column_redactions(df), "privacy", F.concat_ws(":", "column", "kind"), F.col("values")))
    out = out.unionByName(part(duplicate_count(df), "duplicates", F.lit("rows"), F.col("duplicate_rows")))
    out = out.unionByName(part(code_report(df), "codes", F.concat_ws(":", "column", "metric"), F.col("n")))
    out = out.unionByName(part(outlier_report(df, 3.0), "outliers", F.col("column"), F.col("outliers")))
    out = out.unionByName(part(clinical_ranges(df), "clinical", F.col("column"), F.col("invalid")))
    for name, table in (("before", df), ("after", after)):
        if table is not None:
            out = out.unionByName(part(cleaning_score(table), "quality", F.lit(name), F.col("overall")))
    return out
