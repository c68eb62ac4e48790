"""Only what a query reads of a document is worked out, and patterns that are spared or tried in fewer places give the same."""

import random
import re

from pyspark.sql import functions as F

from clearbrook.functions.values import PHI_PATTERNS
from clearbrook.operators import documents, privacy
from clearbrook.plans import queries

BITS = ["BP 120/80", "HR 72", "Temp: 98.6 F", "a.b@c.org", "x@y.co_z@w.net", "@", "a@b", "foo%+-@bar.baz", "\n", "\n\n\n\n", "\r\n", "\t", "  ", " ", " ", "-\n", "hyper-\ntension", "é", "K", "diabeties", "Parkinson", "MI.", "E11.9", "CPT: 99213", "# Plan\n", "\nASSESSMENT:\n", "1. History\n", "hypertension", "aspirin", "chest x-ray", "BMI 25.1 30.2 kg/m2", "HbA1c 6.5% to 7%", "***-**-6789", "123-45-6789", "123456789", "DOB: 1/2/1990", "Dr. Smith", "glucose 110", "SpO2 98%", "﷐", "\x00", "\x1f", "\x7f", "\x85", "\x0b", "word"]


def texts(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(BITS) + r.choice([" ", "", "\n", ", "]) for _ in range(r.randrange(25)))) for i in range(300)]
    return spark.createDataFrame([*rows, (-1, None), (-2, "")], "k int, text string")


def rows_of(df, columns):
    return {r.k: [r[c] for c in columns] for r in df.select("k", *columns).collect()}


def plan_of(spark, df):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wanted_columns_equal_those_of_all(spark):
    df = texts(spark)
    whole = documents.process_documents(df)
    assert [c for c in whole.columns if c.startswith("n_")] == documents.COUNTS
    for wanted in (["redacted", "icd10", "passed", *documents.COUNTS], ["entities", "n_values", "issues"]):
        some = documents.process_documents(df, columns=wanted)
        assert set(some.columns) == {"k", "text", *wanted}
        assert rows_of(some, wanted) == rows_of(whole, wanted)


def test_what_no_query_reads_is_not_worked_out(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    made = queries.case_totals(spark, str(tmp_path))
    assert tuple(made.first()) == (50, 50, 50, 100)
    plan = plan_of(spark, made)
    assert documents.LONG_FORMS["bp"] in plan
    absent = ("olecystectomy", r"HBA1C\D", "creatinine|Creatinine", documents.CPT)
    assert not any(w in plan for w in absent)
    whole = plan_of(spark, documents.process_documents(queries._cases(spark, str(tmp_path))))
    assert all(w in whole for w in absent)


def test_spared_steps_of_cleaning_equal_plain_ones(spark):
    plain = {"remove_control_chars": (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), "normalize_whitespace": (r"(?U)[^\S\n]+", " "), "remove_empty_lines": (r"\n{3,}", "\n\n"), "fix_hyphenation": (r"(?U)(\w+)-\n(\w+)", "$1$2")}
    x = F.col("text")
    for name, (pattern, into) in plain.items():
        made = documents.cleaning_step(x, name)
        assert texts(spark).where(~made.eqNullSafe(F.regexp_replace(x, pattern, into))).isEmpty()
        assert texts(spark).where(made != x).count() > 20


def test_mails_are_tried_only_where_they_can_begin(spark):
    r = random.Random(4)
    said = ["".join(r.choice("aB9._%+-@ ,\n(é") for _ in range(r.randrange(30))) for _ in range(3000)] + ["a@b.co_x@c.org", "a@b.co.x@c.org", "p" * 500 + " a@b.cc"]
    df = spark.createDataFrame([(t,) for t in said], "text string")
    plain, quick = (privacy.spans(F.col("text"), f"(?i){p}") for p in (PHI_PATTERNS["EMAIL"][0], privacy.QUICK["EMAIL"]))
    found = df.select("text", plain.alias("a"), quick.alias("b")).collect()
    assert all(f.a == f.b for f in found)
    assert sum(len(f.a) for f in found) >= 3
    assert all([m.span() for m in re.finditer(PHI_PATTERNS["EMAIL"][0], f.text)] == [(s.start, s.end) for s in f.b] for f in found)


def test_a_text_is_put_in_small_letters_once(spark):
    df = texts(spark).select(documents.measurements(F.col("text")).alias("m"))
    assert plan_of(spark, df).count("lower(text") == 1


def test_numbers_of_entities_and_measurements_equal_their_lists(spark):
    near, far = "Aspirin, aspirin and ASPIRIN", "aspirin" + " word" * 60 + " aspirin, biopsy" + " word" * 60 + " biopsy and mri"
    df = spark.createDataFrame([(near,), (far,), (near + far,), ("Hypertension",), ("Blood Sugar: 110, PULSE 70, o2 sat 97, wt 80",), ("",), (None,)], "text string")
    x = F.col("text")
    found = df.select(documents.entity_count(x).alias("n"), F.size(documents.entity_array(x, documents.sections(x))).alias("m"), documents.measurement_count(x).alias("v"), F.size(documents.measurements(x)).alias("w")).collect()
    assert [r.n for r in found] == [r.m for r in found]
    assert [r.n for r in found] == [1, 5, 5, 1, 0, 0, 0]
    assert [r.v for r in found] == [r.w for r in found] == [0, 0, 0, 0, 4, 0, 0]
