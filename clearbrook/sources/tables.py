"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from clearbrook.functions.text import guard_formula
from clearbrook.operators.charts import clip_text, cross_filter, search_any
from clearbrook.operators.documents import strip_rtf
from clearbrook.operators.stats import kind_of

NULLS = ""


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return checked(spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"', nullValue=NULLS, **options).csv(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a list, of the longest list in an object (the first of equal ones), or the object itself, of each file; nested values as JSON text.

    A file is parsed once as a variant; its records are dealt over the tasks before they become columns. Columns have the type that all
    records agree on, else text; records that aren't objects are one column ``value``. No table of one record is taken for another one's list.
    """
    files = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), F.json_object_keys("value").alias("keys"))
    fields = F.expr("try_variant_get(v, '$', 'map<string,variant>')")
    of = lambda x: F.try_variant_get(x, "$", "array<variant>")
    # Objects forget the order of their keys, the text doesn't.
    sized = F.filter(F.transform("keys", lambda k, i: F.struct(F.size(of(F.element_at(fields, k))).alias("n"), (-i).alias("i"), k.alias("k"))), lambda x: x["n"] >= 0)
    longest = F.array_max(sized)["k"]
    records = F.coalesce(of(F.col("v")), of(F.element_at(fields, longest)), F.array("v"))
    rows = files.select(F.explode(records).alias("r")).repartition(max(2, spark.sparkContext.defaultParallelism))
    rows = rows.select("r", F.expr("try_variant_get(r, '$', 'map<string,variant>')").alias("m"))
    cells = F.coalesce(F.map_entries("m"), F.array(F.struct(F.lit("value").alias("key"), F.col("r").alias("value"))))
    kinds = rows.select(F.explode(cells).alias("c")).groupBy("c.key").agg(F.schema_of_variant_agg("c.value").alias("kind")).orderBy("key").collect()

    def column(name: str, kind: str) -> Column:
        x = F.coalesce(F.element_at("m", F.lit(name)), F.when(F.col("m").isNull(), F.col("r"))) if name == "value" else F.element_at("m", F.lit(name))
        if kind == "BIGINT" or kind == "BOOLEAN":
            return F.try_variant_get(x, "$", kind)
        if kind == "DOUBLE" or kind.startswith("DECIMAL"):
            return F.try_variant_get(x, "$", "double")
        if kind.startswith(("OBJECT", "ARRAY")):
            return F.when(~F.is_variant_null(x), F.to_json(x))
        return F.when(~F.is_variant_null(x), F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))

    return checked(rows.select(*[column(r["key"], r["kind"]).alias(r["key"]) for r in kinds]))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return checked(flatten(spark.read.json(path)))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """A row for each ``row_tag`` element; attributes have a ``_`` in front, nested elements are JSON text."""
    return checked(flatten(spark.read.format("xml").option("rowTag", row_tag).load(path)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, text, n_chars, n_lines, n_words) of text files, one row each: UTF-8, else Latin-1; RTF without its marks."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return document_metadata(raw.select("path", ext.alias("ext"), text.alias("text")).withColumn("text", F.when(F.col("ext") == ".rtf", strip_rtf(F.col("text"))).otherwise(F.col("text"))))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line) of log files for ``logs.parse_lines``: a file is read in many tasks, block being where a task's stretch begins and at the order of lines in it."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def document_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"n_chars": F.length(t), "n_lines": F.regexp_count(t, F.lit("\n")) + 1, "n_words": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))})


def flatten(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (StructType, ArrayType, MapType))]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else df


def checked(df: DataFrame) -> DataFrame:
    """``df``; raises if it has no columns or rows."""
    if not df.columns or df.isEmpty():
        raise ValueError("the table is empty")
    return df


def guarded(df: DataFrame) -> DataFrame:
    """String cells that a spreadsheet would run get a quote in front."""
    strings = [c for c in df.columns if kind_of(df, c) == "string"]
    return df.withColumns({c: guard_formula(F.col(f"`{c}`")) for c in strings}) if strings else df


def write_csv(df: DataFrame, path: str) -> None:
    guarded(df).write.csv(path, header=True, escape='"')


def write_view(df: DataFrame, path: str, chosen: dict[str, str] | None = None, search: str = "") -> None:
    """The rows whose columns equal the ``chosen`` values and of which some column holds ``search``, as guarded CSV."""
    df = cross_filter(df, chosen) if chosen else df
    write_csv(search_any(df, search) if search else df, path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """One folder for each key with the text in it."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path, lineSep="\n")


#: Clipped columns of exported tables.
CLIPS = {"text": 80, "section": 100, "context": 150, "contexts": 150, "heading": 120, "message": 120, "raw_reference": 140}


def write_derived(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A derived table with white space collapsed and long cells clipped, columns in the given order."""
    df = df.select(*(columns or df.columns))
    write_csv(df.withColumns({c: clip_text(F.col(c), n) for c, n in CLIPS.items() if c in df.columns}), path)


def dealt(df: DataFrame, rows: int = 8192) -> DataFrame:
    """``df`` dealt over as many tasks as it has times ``rows`` rows. Spark cuts tables by their bytes, and a table of a few bytes a row by its row groups, so work that takes long for each row would lie in few tasks."""
    return df.repartition(max(1, -(-df.count() // rows)))
