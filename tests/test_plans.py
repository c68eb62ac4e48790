"""Quantiles without a single task, fixed values, documents with several headings, reports."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearbrook.functions import text
from clearbrook.operators import categories, charts, dedup, documents, harmonize, logs, missing, numeric, privacy, profile, review, stats
from clearbrook.plans import pipeline


@pytest.mark.parametrize("margin,ranked", [(stats.MARGIN, stats.RANKED), (1e-4, 3)])
def test_exact_quantiles_equal_sorting(spark, monkeypatch, margin, ranked):
    r = random.Random(2)
    columns = [[r.gauss(0, 1) for _ in range(3000)], [float(r.randrange(5)) for _ in range(3000)], [None] * 3000, [r.random() if i % 3 else None for i in range(3000)]]
    df = spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(f"c{i} double" for i in range(len(columns)))).repartition(3)
    monkeypatch.setattr(stats, "MARGIN", margin)
    monkeypatch.setattr(stats, "RANKED", ranked)
    probs = [0.0, 0.25, 0.731]
    got = stats.exact_quantiles(df, [F.col(c) for c in df.columns], probs)
    for values, q in zip(columns, got, strict=True):
        known = [v for v in values if v is not None]
        assert q == ([None] * 3 if not known else pytest.approx(list(np.quantile(known, probs)), rel=1e-12, abs=1e-12))
    assert stats.exact_quantiles(df.limit(0), [F.col("c0")], [0.5]) == [[None]]


def test_group_medians_and_most_frequent_values(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.random() if r.random() > 0.1 else None) for _ in range(2000)] + [("only nulls", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "x string, y double")
    out = {x.label: x.value for x in charts.group_aggregate(df, "x", "y", "median").collect()}
    for k in "abc":
        assert out[k] == pytest.approx(statistics.median(v for x, v in rows if x == k and v is not None), rel=1e-12)
    assert out["only nulls"] == 0.0 and out["null"] == 1.0
    df = spark.createDataFrame([("b", 1), ("a", 1), ("b", None), ("a", None), (None, None)], "s string, n int")
    assert stats.most_frequent(df, ["s", "n"]) == {"s": "a", "n": 1}


def test_roles_and_domains_follow_the_fixed_words(spark):
    some = [("2020-01-01",), ("2020-02-01",), ("x",), ("y",), ("z",)]
    for name in stats.DATE_WORDS:
        assert stats.classify(spark.createDataFrame(some, f"{name}_of string")) == {f"{name}_of": "date"}
    for name in ("year", "month", "day", "timestamp_"[:-1].replace("time", "tim")):
        assert stats.classify(spark.createDataFrame(some, f"{name} string")) == {name: "categorical"}
    for name in harmonize.HEALTH_WORDS:
        assert harmonize.suggest_names([name, "note"]) == harmonize.suggest_names([name, "note"], "healthcare")
    for name in ("admission", "discharge", "blood", "heart"):
        assert harmonize.suggest_names([name]) == harmonize.suggest_names([name], "general")


def test_confirming_sections_and_spelling(spark):
    for kind, word in (("DISEASE", "impression"), ("DISEASE", "comorbid"), ("DRUG", "rx"), ("DRUG", "therapy"), ("PROCEDURE", "exam"), ("PROCEDURE", "laboratory")):
        said = {"DISEASE": "asthma", "DRUG": "aspirin", "PROCEDURE": "biopsy"}[kind]
        row = documents.entities(spark.createDataFrame([(1, f"# {word} of today\nThen {said} again")], "k int, text string"), "k").first()
        assert (row.type, row.confidence, row.section_id) == (kind, 0.95, "SEC-001")
    assert documents.entities(spark.createDataFrame([(1, "# plan\nThen biopsy")], "k int, text string"), "k").first().confidence == 0.8
    df = spark.createDataFrame([("parkinson's disease, Parkinson, parkinsons and diabeties",)], "x string").select(text.fold_replaced(F.col("x"), documents.TEXT_MISSPELLINGS, True).alias("y"))
    assert df.first().y.text == "parkinson's disease, parkinson's, parkinson's and diabetes" and df.first().y.n == 3


def test_sections_of_a_long_document_against_line_by_line(spark):
    import re

    lines = ["before", "", "  # First  one ", "a b", "", "c", "VITAL SIGNS:", "x", "ABC", "PLAN: rest now  ", "y z", "2. Next Step", "3. not one", "ABCD", "last  "] * 40
    forms = [r"^#{1,6}\s+(.+)$", r"^([A-Z][A-Z\s&/\-]{3,}):?\s*$", r"^[A-Z][A-Z\s&/\-]{3,}:\s*(.+)$", r"^\d+\.\s+([A-Z].+)$"]
    want, at = [], 0
    for i, x in enumerate(lines):
        hit = next((m[1].strip() for f in forms if (m := re.match(f, x.strip()))), None)
        if hit is not None:
            want.append([hit, i + 1, at, []])
        elif want and x.strip():
            want[-1][3].append(x)
        at += len(x) + 1
    got = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "t string").select(documents.sections(F.col("t")).alias("s")).collect()
    assert [(s.heading, s.line_start, s.start, s.content, s.word_count) for s in got[0].s] == [(h, n, p, "\n".join(c).strip(), len(" ".join(c).split())) for h, n, p, c in want]
    assert not got[1].s and got[2].s == []


def test_spans_hold_groups_and_offsets(spark):
    t = "id 12-34, then é 5-6 and 7-89"
    rows = spark.createDataFrame([(t,), (None,), ("none",)], "t string").select(privacy.spans(F.col("t"), r"(\d+)-(\d+)", 1, 2).alias("s")).collect()
    assert [(s.match, s.g1, s.g2) for s in rows[0].s] == [("12-34", "12", "34"), ("5-6", "5", "6"), ("7-89", "7", "89")] and all(t[s.start : s.end] == s.match for s in rows[0].s)
    assert rows[1].s == [] and rows[2].s == []


def test_redaction_report_and_counts_of_repairs(spark):
    df = spark.createDataFrame([(1, "Call 555-123-4567 or a@b.org and c@d.org"), (2, "nothing"), (3, None)], "k int, text string")
    done = privacy.redact_text(df)
    r = privacy.redaction_report(done).first()
    assert (r.documents, r.redactions, r.high) == (3, 3, 3) and r.by_category["Email addresses: EMAIL"] == 2
    found = {x.type: (x.findings, x.documents) for x in privacy.finding_summary(done).collect()}
    assert found == {"EMAIL": (2, 1), "PHONE": (1, 1)}
    c = documents.clean_documents(spark.createDataFrame([("it’s “so” a-\nb",)], "text string")).first()
    assert c.changes["fix_encoding_artifacts"] == 3 and c.changes["fix_hyphenation"] == 1 and c.cleaned == 'it\'s "so" ab'


def test_rules_violations_outliers_and_near_duplicates_are_reported(spark):
    rows = [("2020-01-0" + str(i % 2 + 1), "Hubei", float(10 + i), 5.0) for i in range(30)] + [("2020-01-01", "Hubei", 1000.0, 5.0), ("2020-01-02", "Hubei", 3.0, 25.0), ("2020-01-02", "Hubei", 3.0, 25.0)]
    done = pipeline.auto_clean_reports(spark.createDataFrame(rows, "ObservationDate string, Province string, Confirmed double, Deaths double"))
    assert done.cleaned.count() == 32 and done.cleaned.where("Confirmed < Deaths").count() == 0
    assert {r.rule: r.violations for r in done.violations.collect()} == {"confirmed < deaths": 2}
    assert [r.column for r in done.outliers.collect()] == ["Confirmed", "Deaths"][: done.outliers.count()] and done.near_duplicates.count() == 32
    log = [(r.category, r.metric) for r in done.log.orderBy("step").collect()]
    assert ("duplicates", "exact rows dropped") in log and ("numbers", "violations fixed") in log and ("dates", "parsed") in log
    assert {r.column: r.action for r in done.audit.collect()} == {"ObservationDate": "none", "Province": "none", "Confirmed": "none", "Deaths": "none"}


def test_recommendations_follow_the_share_of_all_cells(spark):
    df = spark.createDataFrame([(None if i < 60 else i, None, "x y" if i % 2 else "X Y") for i in range(100)], "a int, icd_code string, note string")
    rows = [(r.priority, r.operation) for r in profile.recommendations(df).collect()]
    assert rows == [("HIGH", "remove_duplicates"), ("HIGH", "handle_missing"), ("HIGH", "redact_phi"), ("MEDIUM", "standardize_codes"), ("MEDIUM", "ml_impute_missing"), ("MEDIUM", "remove_high_missing"), ("LOW", "clean_text")]


def test_codes_are_routed_and_counted(spark):
    df = spark.createDataFrame([("Diabeties", "99", "2345-7"), ("e11.9", "12345", "1-1"), ("zzz", None, None)], "diagnosis string, procedure_code string, loinc string")
    out = categories.standardise_codes(df).collect()
    assert sorted(str(r.procedure_code) for r in out) == ["00099", "12345", "None"] and {r.loinc for r in out} == {"2345-7", "1-1", None}
    assert {(r.column, r.metric): r.n for r in categories.code_report(df).collect()} == {("diagnosis", "exact"): 1, ("diagnosis", "code"): 1, ("diagnosis", "unrecognised"): 1, ("loinc", "valid"): 1, ("loinc", "unrecognised"): 1}


def test_quality_of_documents_and_logs(spark):
    docs = spark.createDataFrame([("a", "# Assessment\nasthma and aspirin, Troponin: 2.4"), ("log", "2024-01-15 08:00:00 [INFO] LAB-RESULT: Troponin I: 2.4 ng/mL [H] | Reference: 0.0-0.4\n2024-01-15 08:01:00 [INFO] EMR-SYSTEM: check-in"), ("none", "plain words"), ("null", None)], "k string, text string")
    processed = documents.process_documents(docs)
    events = logs.normalise_logs(docs.where("k = 'log'"), "k")
    out = {r.k: r for r in documents.quality_report(processed, "k", events).collect()}
    assert (out["a"].document_structure, out["a"].clinical_coverage, out["a"].log_structure) == (40 + 8 + 2 * 2, 41, 100)
    assert out["log"].structured == 2 and out["log"].labs == 1 and out["none"].issues == [documents.NO_SIGNAL] and len(out) == 4
    assert out["none"].overall == round((100 + 100 + 35 + 40) / 4) and out["none"].grade == "D"


def test_flagged_events_and_the_reviewed_split(spark):
    entries = spark.createDataFrame([("1", "lab", 60.0, True, {"a": "b"}), ("2", "lab", 90.0, False, {"a": "b"}), ("3", "x", None, None, None)], "entry_id string, event_type string, normalization_confidence double, review_needed boolean, normalized_payload map<string,string>")
    decisions = spark.createDataFrame([("1", 1, "Ann", "t", "approved", None, "", None)], review.SCHEMA)
    assert sorted(r.entry_id for r in review.flagged(entries, decisions).collect()) == ["1", "3"]
    done, pending = review.split_reviewed(entries, decisions)
    assert [r.entry_id for r in done.collect()] == ["1"] and sorted(r.entry_id for r in pending.collect()) == ["2", "3"]
    assert [r.event_type for r in review.most_flagged(review.review_summary(entries), 1).collect()] == ["lab"]


def test_changes_heads_and_model_defaults(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0)], "a int, b double")
    out = {r.metric: (r.before, r.after) for r in profile.changes(df, dedup.drop_exact(missing.handle_missing(df))).collect()}
    assert out["rows"] == (3, 2) and out["missing_cells"] == (2, 0) and out["duplicate_rows"] == (1, 0)
    assert [r.a for r in dedup.head(df, 2, ["a"]).collect()] == [1, 1] and profile.new_columns(df, df.withColumn("c", F.lit(1))) == ["c"]
    assert numeric.fix_negatives(df).count() == 3 and profile.preview(df, 1).count() == 1
