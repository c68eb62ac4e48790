"""Categories and medical codes: fuzzy merging, code lookup, spelling. All of it works on distinct values, which are joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.names import unused
from clearbrook.functions.text import category_case, expand_words, fold_replace, pad_cpt, title_case, trim_collapse
from clearbrook.functions.values import DISEASE_CODES, LOINC_NAMES, SPELLING_FIXES, WORD_ABBREVIATIONS
from clearbrook.operators.similarity import SMALL_ROWS, mapped, similar
from clearbrook.operators.stats import column_stats, kind_of
from clearbrook.sources.staging import staged

#: Parts of column names that say what a column holds.
ICD_WORDS = ["icd", "diagnosis", "dx_code"]
DISEASE_WORDS = ["disease", "condition", "illness", "disorder", "comorbidity"]
CPT_WORDS = ["cpt", "procedure"]
LOINC_WORDS = ["loinc", "lab_code", "test_code"]
SKIPPED = ["Unknown", "", "nan"]


def merge_variants(df: DataFrame, column: str, least: int = 85) -> DataFrame:
    """``merge_all_variants`` of one column."""
    return merge_all_variants(df, [column], least)


def merge_all_variants(df: DataFrame, columns: list[str], least: int = 85) -> DataFrame:
    """Every value of a column becomes the most frequent one among those of the column whose rounded ratio to it is ``least`` or more (of equal ones the more similar, then the shorter, then the larger). Values of all columns are counted in one pass and met by one similarity join, however many there are."""
    if not columns:
        return df
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.explode(cells).alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.col("v").isin(*SKIPPED)).groupBy("i", "v").count()
    counts = staged(counts, "value-counts")
    values = counts.select("v").distinct()
    pairs = similar(values, values, least - 0.5).withColumn("r", F.round("ratio")).where((F.col("r") >= least) & (F.col("a") != F.col("b")))
    met = pairs.join(counts.select("i", F.col("v").alias("a")), "a").join(counts.select("i", F.col("v").alias("b"), F.col("count").alias("n")), ["i", "b"])
    rank = F.struct("n", "r", (-F.length("b")).alias("l"), "b")
    best = met.groupBy("i", F.col("a").alias("v")).agg(F.max(rank).alias("best")).join(counts, ["i", "v"])
    own = F.struct(F.col("count").alias("n"), F.lit(100.0).alias("r"), (-F.length("v")).alias("l"), F.col("v").alias("b"))
    merged = staged(best.where(F.col("best") > own).select("i", "v", F.col("best.b").alias("out")), "merged-values")
    small = merged.count() <= SMALL_ROWS
    for i, c in enumerate(columns):
        key, out = unused(df.columns, "v", "out")
        table = merged.where(F.col("i") == i).select(F.col("v").alias(key), F.col("out").alias(out))
        df = df.join(F.broadcast(table) if small else table, F.col(f"`{c}`") == F.col(key), "left").withColumn(c, F.coalesce(out, F.col(f"`{c}`"))).drop(key, out)
    return df


def diseases(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(DISEASE_CODES.items())], "disease string, code string, ord int")


def standardise_icd(df: DataFrame, column: str, fuzzy: bool = True) -> DataFrame:
    """ICD-10 codes: a valid code in plain form; else the code of the spelled-right name, of the longest name held, of the most similar one (80 or more); else upper case."""
    return _mapped(df, column, lambda values, known: _icd_lookup(values, known, fuzzy))


def _mapped(df: DataFrame, column: str, lookup) -> DataFrame:  # noqa: ANN001
    values = df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct()
    return mapped(df, column, lookup(staged(values, "values"), diseases(df)))


def _best_fuzzy(values: DataFrame, known: DataFrame) -> DataFrame:
    """Most similar disease of each value, at a ratio of 80 or more."""
    fixed = staged(values.select("v", "fixed"), "open-values")
    pairs = similar(fixed.select(F.col("fixed").alias("v")).distinct(), known.select(F.col("disease").alias("v")), 80)
    met = pairs.withColumnsRenamed({"a": "fixed", "b": "disease", "ratio": "r"}).join(F.broadcast(known), "disease")
    best = met.groupBy("fixed").agg(F.max_by(F.struct("disease", "code"), F.struct("r", F.expr("-ord"))).alias("f"))
    return fixed.join(best, "fixed").select("v", F.col("f.disease").alias("fuzzy_name"), F.col("f.code").alias("fuzzy_code"))


def _icd_lookup(values: DataFrame, known: DataFrame, fuzzy: bool) -> DataFrame:
    bare = F.upper(F.regexp_replace("v", r"[\s.]", ""))
    code = F.when(bare.rlike(r"^[A-Z]\d{2}\d{0,4}$"), F.when(F.length(bare) > 3, F.concat(F.substring(bare, 1, 3), F.lit("."), F.substring(bare, 4, 9))).otherwise(bare))
    values = values.withColumns({"plain": code, "fixed": fold_replace(F.lower(F.trim("v")), SPELLING_FIXES, False)})
    exact = values.join(F.broadcast(known), F.col("fixed") == F.col("disease"), "left").select("v", "plain", "fixed", F.col("code").alias("exact"))
    held = values.join(F.broadcast(known), F.col("fixed").contains(F.col("disease"))).groupBy("v").agg(F.max_by("code", F.struct(F.length("disease"), F.expr("-ord"))).alias("held"))
    out = exact.join(held, "v", "left")
    if fuzzy:
        open_ = out.where("plain is null and exact is null and held is null").select("v", "fixed")
        out = out.join(_best_fuzzy(open_, known), "v", "left")
    else:
        out = out.withColumn("fuzzy_code", F.lit(None).cast("string"))
    return out.withColumn("out", F.coalesce("plain", "exact", "held", "fuzzy_code", F.upper("v")))


def normalise_disease(df: DataFrame, column: str) -> DataFrame:
    """Title-cased disease names: the spelled-right name if known, else the most similar one (80 or more), else the value itself."""

    def lookup(values: DataFrame, known: DataFrame) -> DataFrame:
        values = values.withColumn("fixed", fold_replace(F.lower(F.trim("v")), SPELLING_FIXES, False))
        out = values.join(F.broadcast(known), F.col("fixed") == F.col("disease"), "left").select("v", "fixed", "disease")
        out = out.join(_best_fuzzy(out.where("disease is null").select("v", "fixed"), known), "v", "left")
        return out.withColumn("out", title_case(F.coalesce("disease", "fuzzy_name", "fixed")))

    return _mapped(df, column, lookup)


def loinc_report(df: DataFrame, column: str) -> DataFrame:
    """(valid, unrecognised) counts of non-null codes."""
    known = F.trim(F.col(f"`{column}`").cast("string")).isin(*LOINC_NAMES)
    return df.agg(F.count_if(known).alias("valid"), F.count_if(~known).alias("unrecognised"))


def standardise_codes(df: DataFrame) -> DataFrame:
    """Every string column by its name: ICD-10, disease names, CPT or LOINC (whose values stay; ``code_report`` counts them); the first that fits."""
    for c in df.columns:
        n = c.lower()
        if kind_of(df, c) != "string":
            continue
        if any(w in n for w in ICD_WORDS):
            df = standardise_icd(df, c)
        elif any(w in n for w in DISEASE_WORDS):
            df = normalise_disease(df, c)
        elif any(w in n for w in CPT_WORDS):
            df = df.withColumn(c, pad_cpt(F.trim(F.col(f"`{c}`"))))
    return df


def code_report(df: DataFrame) -> DataFrame:
    """(column, metric, n): how many values of ICD-10 columns are codes, map exactly, by a name they hold, by likeness or not at all, and how many of LOINC columns are known. Counted over distinct values."""
    out = df.sparkSession.createDataFrame([], "column string, metric string, n long")
    for c in df.columns:
        name = c.lower()
        if kind_of(df, c) != "string":
            continue
        if any(w in name for w in ICD_WORDS):
            counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).count()
            found = counts.join(_icd_lookup(counts.select("v"), diseases(df), True), "v")
            way = F.when(F.col("plain").isNotNull(), "code").when(F.col("exact").isNotNull(), "exact").when(F.col("held").isNotNull(), "held").when(F.col("fuzzy_code").isNotNull(), "fuzzy").otherwise("unrecognised")
            out = out.unionByName(found.groupBy(way.alias("metric")).agg(F.sum("count").alias("n")).select(F.lit(c).alias("column"), "metric", "n"))
        elif any(w in name for w in LOINC_WORDS) and not any(w in name for w in [*DISEASE_WORDS, *CPT_WORDS]):
            out = out.unionByName(loinc_report(df, c).select(F.lit(c).alias("column"), F.expr("stack(2, 'valid', valid, 'unrecognised', unrecognised) as (metric, n)")))
    return out


def clean_text_columns(df: DataFrame) -> DataFrame:
    """Spaces repaired in every string column; title case where it has under 50 values."""
    stats = column_stats(df, distinct=True, quantiles=False)
    new = {}
    for c, s in stats.items():
        if s.kind == "string":
            x = trim_collapse(F.col(f"`{c}`"))
            new[c] = title_case(x) if (s.distinct or 0) < 50 else x
    return df.withColumns(new) if new else df


def standardise_categories(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Spaces repaired in text and categories; case and spelling variants of categories merged."""
    strings = [c for c in df.columns if kind_of(df, c) == "string" and roles.get(c) in ("categorical", "text")]
    if strings:
        df = df.withColumns({c: category_case(trim_collapse(F.col(f"`{c}`"))) if roles[c] == "categorical" else trim_collapse(F.col(f"`{c}`")) for c in strings})
    return merge_all_variants(df, [c for c in strings if roles[c] == "categorical"])


#: Parts of names of columns whose text isn't clinical.
NOT_CLINICAL = [
    "country", "region", "state", "province", "city", "district", "county", "nation", "territory", "location", "place", "area", "zone",
    "name", "first_name", "last_name", "full_name", "date", "time", "timestamp", "update", "created", "modified",
    "id", "code", "key", "index", "sno", "s_no", "serial", "email", "phone", "address", "url", "link", "path", "file",
    "lat", "lon", "latitude", "longitude", "geo", "zip", "pincode",
]


def normalise_clinical_text(df: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """Abbreviations spelled out and spelling fixed in string columns, but for those whose name holds a word of ``skip`` or that hold redaction marks."""
    skip = NOT_CLINICAL if skip is None else skip
    columns = [c for c in df.columns if kind_of(df, c) == "string" and not any(w in c.lower() for w in skip)]
    if not columns:
        return df
    marked = df.agg(*[F.max(F.col(f"`{c}`").contains("REDACTED")).alias(c) for c in columns]).first()
    return df.withColumns({c: fold_replace(expand_words(F.col(f"`{c}`"), WORD_ABBREVIATIONS), SPELLING_FIXES, bounded=False) for c in columns if not marked[c]})
