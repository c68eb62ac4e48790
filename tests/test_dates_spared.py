"""Dates are tried only in formats that can fit."""

from pyspark.sql import functions as F

from clearbrook.functions import dates


def test_dates_that_are_spared_a_format_never_fit_it(spark):
    said = ["2020-01-23", " 2020-01-23 ", "2020-01-23 04:05:06", "2020-01-23T04:05:06", "1/2/2020", "1/2/2020 3:04", "1-2-2020", "2020/1/2", "Jan 2 2020", "jan 12 2020", "2 Jan 2020", "31/12/2020", "+12020-01-02", "-2020-01-02", "2020-13-01", "2/30/2020", "1-URGENT", "5-LOW", "Unknown", "", "4-NOT SPECIFIED", "12", "Jan 2020", "2020", "1:2", "Customer#1", "١/2/2020", "25-989-741-2988", "a-1/b:2", None]
    df = spark.createDataFrame([(t,) for t in said], "x string")
    for formats in (dates.FORMATS, dates.DOCUMENT_FORMATS, ["MMM yyyy", "yyyyMMdd"]):
        plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in formats])
        rows = df.select("x", dates.parse_date(F.col("x"), formats).cast("string").alias("got"), plain.cast("string").alias("want")).collect()
        assert [(r.x, r.got) for r in rows] == [(r.x, r.want) for r in rows] and any(r.got for r in rows)


def test_texts_without_two_numbers_are_tried_in_no_format(spark):
    parsed = F.try_to_timestamp

    def counted(x, f):
        return F.when(F.raise_error(F.concat(F.lit("tried "), x)).isNull(), parsed(x, f))

    df = spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("Unknown",), (None,)], "x string")
    try:
        dates.F.try_to_timestamp = counted
        column = dates.parse_date(F.col("x"))
    finally:
        dates.F.try_to_timestamp = parsed
    assert [r.d for r in df.select(column.alias("d")).collect()] == [None] * 4
