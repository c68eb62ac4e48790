"""The corpus pipeline: stages that each keep what a training corpus should hold, applied to ``documents`` in turn.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return
the columns of documents, whatever their names: columns named like an operator's output come through as they were.
Null texts count as empty, repeated rows each count (but the near-duplicate stage keeps one), an empty table gives
an empty one, and texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.decontaminate import find_contaminated
from clearbrook.llm.pieces import digest_texts, load_model
from clearbrook.llm.pii import OUTPUTS, pseudonymise, surrogate_key
from clearbrook.llm.shared import given, load, staged
from clearbrook.llm.simhash import NEAR_OUTPUTS, first_of_each_group
from clearbrook.llm.toxicity import model_for, score_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside the held-out third, predicts as toxic go."""
    model = model_for(docs, load(spark, sf_dir, "labels"))
    return given(score_toxicity(docs, model).where("predicted = 0"), docs, ["score", "predicted"])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with five-word shingle similarity of 0.8 or more, one document stays: that with the smallest doc_id."""
    return given(first_of_each_group(docs), docs, NEAR_OUTPUTS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return given(find_contaminated(docs, load(spark, sf_dir, "benchmark")).where(F.size("items") == 0), docs, ["items"])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by surrogates; n_chars follows the new text."""
    done = pseudonymise(docs, key=surrogate_key(spark)).withColumn("text", F.col("surrogate_text"))
    done = given(done, docs, OUTPUTS)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the number and digest of their pieces and of the decoded text."""
    return digest_texts(docs, load_model())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("sentencepiece", tokens),
]

#: Fitted scores, components and subword pieces are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
