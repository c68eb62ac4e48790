"""The similarity join against all pairs, and names of columns that operators use for a while."""

import random

import pytest
from pyspark.sql import functions as F

from clearbrook.operators import categories, dedup, documents, missing, numeric, privacy, profile
from clearbrook.operators.similarity import similar


def plain_ratio(a: str, b: str) -> float:
    x, y = ("".join(c if c.isalnum() else " " for c in s.lower()).strip() for s in (a, b))
    row = [0] * (len(y) + 1)
    for c in x:
        last, row = row, [0]
        for j, d in enumerate(y):
            row.append(max(row[-1], last[j + 1], last[j] + (c == d)))
    return 200 * row[-1] / (len(x) + len(y)) if x or y else 0.0


def mistyped(rng: random.Random, s: str) -> str:
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(s) + 1)
        s = s[:i] + rng.choice(["", rng.choice("abcdeß é-")]) + s[i + rng.randint(0, 1) :]
    return s


@pytest.mark.parametrize("least", [70, 80, 84.5, 100])
def test_all_pairs_are_found(spark, least):
    rng = random.Random(int(least))
    roots = ["".join(rng.choice("abcab ") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21]))) for _ in range(40)]
    left, right = ({mistyped(rng, rng.choice(roots)) for _ in range(90)} for _ in range(2))
    want = {(a, b): r for a in left for b in right if (r := plain_ratio(a, b)) >= least - 1e-9}
    sides = [spark.createDataFrame([(v,) for v in [*x, None]], "v string") for x in (left, right)]
    got = {(r.a, r.b): r.ratio for r in similar(*sides, least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert similar(sides[0].limit(0), sides[1], least).collect() == []


def test_many_values_merge_without_a_cap(spark):
    """50,000 values: 25,000 stems of random letters, far from each other, and a mistyped form of each."""
    rng = random.Random(8)
    stems = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(25_000)})
    rows = [(s, 2) for s in stems] + [(s[:5] + s[6:] + "-", 1) for s in stems]
    df = spark.createDataFrame(rows, "c string, times int").select(F.explode(F.array_repeat("c", F.col("times"))).alias("c"))
    got = {r.c: r["count"] for r in categories.merge_variants(df, "c").groupBy("c").count().collect()}
    assert got == dict.fromkeys(stems, 3)


NAMES = ["v", "w", "out", "_v", "_code", "_f", "_k0", "_s0", "_s", "_b", "_p", "_features", "cleaned", "findings", "n", "r"]


def test_names_that_operators_use_come_through(spark):
    rows = [(i, ["asthma", "Asthma", "astma", "J45"][i % 4], float(i), *[f"{n}{i}" for n in NAMES]) for i in range(24)]
    df = spark.createDataFrame(rows, ["id", "diagnosis", "x", *NAMES])
    want = sorted(map(tuple, df.select(*NAMES).collect()))
    operators = {
        "merge": lambda d: categories.merge_variants(d, "diagnosis"), "icd": lambda d: categories.standardise_icd(d, "diagnosis"), "disease": lambda d: categories.normalise_disease(d, "diagnosis"),
        "codes": lambda d: numeric.label_codes(d, "diagnosis"), "negatives": lambda d: numeric.fix_negatives(d, ["x"]), "rules": lambda d: numeric.at_least(d, [("x", "id")])[0],
        "near": lambda d: dedup.near_duplicate_rows(d, ["diagnosis"]), "impute": lambda d: missing.model_impute(d.withColumn("x", F.when(F.col("id") > 2, F.col("x"))), "x", trees=2),
        "names": lambda d: privacy.identifier_values(d, "diagnosis"), "clean": lambda d: documents.clean_documents(d, "diagnosis").withColumnsRenamed({"cleaned": "c", "cleaned_in": "cleaned"}),
        "redact": lambda d: privacy.redact_text(d.withColumnRenamed("findings", "f"), "diagnosis").drop("findings").withColumnRenamed("f", "findings"),
    }
    for name, run in operators.items():
        assert sorted(map(tuple, run(df).select(*NAMES).collect())) == want, name


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (None,)], "x double")
    assert profile.null_profile(df).first().nulls == 2 and profile.column_statistics(df, "x").first().asDict() == {"count": 3, "nulls": 2, "mean": 2.0, "median": 2.0, "std": 1.0, "min": 1.0, "max": 3.0}
    assert [r.x_z for r in numeric.z_scores(df, ["x"]).collect()] == [-1.0, 0.0, 1.0, None, None]
    many = spark.createDataFrame([(float(i),) for i in range(1, 200)] + [(-5.0,), (float("nan"),)], "x double")
    fixed = [r.x for r in numeric.fix_negatives(many).collect()]
    assert fixed[199] == 100.0 and fixed[200] != fixed[200]


def test_codes_are_dense_whatever_the_ranges(spark):
    values = [f"v{(i * 37) % 1000:04d}" for i in range(3000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "c string").repartition(7)
    order = {v: i for i, v in enumerate(sorted({v for v in values if v}))}
    assert all(r.c_encoded == order.get(r.c, -1) for r in numeric.label_codes(df, "c").collect())
