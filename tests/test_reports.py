"""Samples, inspections and filtered exports."""

import json

from clearbrook.operators import profile
from clearbrook.sources.tables import write_view


def test_samples_keep_nulls_and_are_bounded(spark):
    a = spark.createDataFrame([(i, None) for i in range(40)], "i int, v string")
    rows = profile.compare_samples(a, a.where("i < 3"), 25).collect()
    assert [sum(r.table == t for r in rows) for t in ("before", "after")] == [25, 3] and json.loads(rows[0].row) == {"i": 0, "v": None}


def test_an_inspection_is_a_set_of_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, c string")
    found = profile.inspection(df)
    assert found["duplicates"].first().duplicate_rows == 1 and {r.column: r.nulls for r in found["nulls"].collect()} == {"i": 0, "c": 1}
    assert {r.column: r.role for r in found["roles"].collect()} == {"i": "categorical", "c": "categorical"}


def test_a_view_is_filtered_before_it_is_written(spark, tmp_path):
    df = spark.createDataFrame([("x", "=1+1", 1), ("x", "other", 2), ("y", "=1+1", 3)], "k string, v string, n int")
    write_view(df, f"{tmp_path}/view", {"k": "x"}, "1+")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/view", header=True).collect()] == [("x", "'=1+1", "1")]
