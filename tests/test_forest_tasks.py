"""Rows of a forest lie in tasks of a bounded size."""

from pyspark.sql import functions as F

from clearbrook.operators import missing


def test_a_forest_is_fitted_on_rows_dealt_over_tasks(spark, monkeypatch):
    seen = []

    class Forest(missing.RandomForestRegressor):
        def fit(self, df):
            seen.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
            return super().fit(df)

    monkeypatch.setattr(missing, "RandomForestRegressor", Forest)
    df = spark.range(90_000).coalesce(1).select("id", F.when(F.col("id") % 9 != 0, F.col("id") * 2.0).alias("x"))
    filled = missing.model_impute(df, "x", trees=2)
    assert len(seen) == 3 and sum(seen) == 80_000 and max(seen) <= missing.FOREST_ROWS
    assert filled.count() == 90_000 and filled.where("x is null").isEmpty() and filled.where("id % 9 != 0 and x != id * 2").isEmpty()
