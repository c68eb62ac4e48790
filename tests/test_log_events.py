"""Log events are worked out once a row, and only what a query reads."""

from pyspark.sql import functions as F

from clearbrook.functions.text import MARK, PART
from clearbrook.operators import logs
from clearbrook.plans import queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_query_works_out_only_the_columns_that_it_reads(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("signup").alias("event_type"), F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    plans = {n: _plan(queries.QUERIES[n](spark, str(tmp_path))) for n in ("log_events", "review_statistics", "medications")}
    assert all("(?ms)^" in p for p in plans.values()) and "sliding scale" in plans["medications"]
    assert not any(w in plans[n] for n in ("log_events", "review_statistics") for w in ("sliding scale", "ng/mL)?"))


def test_texts_with_marks_keep_them(spark):
    text = f"2024-01-01 08:00:00 [INFO] PHARMACY: Aspirin 81 mg PO ordered {PART}\n2024-01-01 08:01:00 [WARN] LAB-RESULT: K{MARK}+: 3.1\n\t mmol\n"
    rows = logs.normalise_logs(spark.createDataFrame([(1, text), (2, text.replace(PART, "x").replace(MARK, ""))], "k int, text string"), "k").orderBy("k", "line_number").collect()
    assert [r.message for r in rows] == [f"Aspirin 81 mg PO ordered {PART}", f"K{MARK}+: 3.1 mmol", "Aspirin 81 mg PO ordered x", "K+: 3.1 mmol"]
    assert [r.line_number for r in rows] == [1, 2, 1, 2] and [r.normalized_payload.get("dose") for r in rows] == ["81", None, "81", None]
    assert [r.normalized_payload.get("value") for r in rows] == [None, None, None, "3.1"] and [r.normalized_payload.get("route") for r in rows[::2]] == ["oral", "oral"]
