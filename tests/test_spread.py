"""Work on each row lies in many tasks, is done once, and patterns are only spared where they can't match."""

import re

from pyspark.sql import functions as F

from clearbrook.functions.names import worked_out
from clearbrook.functions.values import MEASUREMENTS
from clearbrook.operators import documents, privacy
from clearbrook.plans import queries


def test_thin_rows_are_dealt_before_texts_are_made(spark, tmp_path):
    events = spark.range(20_000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.timestamp_seconds("id").alias("ts"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(9_000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for made, tasks, rows in ((queries._notes, 3, 20_000), (queries._log_text, 3, 20_000), (queries._cases, 2, 9_000)):
        texts = made(spark, str(tmp_path))
        sizes = texts.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == tasks and sum(r["count"] for r in sizes) == rows


def test_worked_out_keeps_rows_names_and_places(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "_w0 int, x string")
    out = worked_out(df, {"x": F.upper("x"), "y": F.length("x")})
    assert out.columns == ["_w0", "x", "y"] and sorted(map(tuple, out.collect())) == [(1, "A", 1), (2, None, None)]


def test_words_that_spare_patterns_are_parts_of_every_match(spark):
    for name, pattern in MEASUREMENTS.items():
        first = re.match(r"\(\?:([^()]+)\)", pattern)[1].split("|")
        texts = [w.replace(r"\s*", " ") + ": 12/34"[: 5 if name == "respiratory_rate" else None] for w in first]
        assert all(any(w in t.lower() for w in documents.measurement_words()[name]) for t in texts)
    said = ["MRN 1234567", "MEDICAL RECORD #1234567", "a@b.org", "Date OF birth: 1/2/1990", "DOB 1990-01-02", "1/2/1990", "10.0.0.1", "npi 1234567890", "Member ID: ABC 12", "Patient: Jane Doe", "DR. Smith", "provider Smith", "xxx-xx-6789", "***-**-6789", "123-45-6789", "123456789", "(555) 123-4567", "4111 1111 1111 1111", "1234 5678 9012", "1 Main Street"]
    df = spark.createDataFrame([(t,) for t in said], "text string")
    assert all(r.findings for r in privacy.with_findings(df).collect())
