"""Review of uncertain events: flagged entries, decisions, final payloads, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ["approved", "rejected", "modified"]
SCHEMA = "entry_id string, seq long, reviewer_name string, timestamp string, decision string, modified_payload map<string,string>, notes string, confidence_override double"


def record_decisions(decisions: DataFrame, path: str | None = None) -> DataFrame:
    """Decisions as they are kept: names of 100 characters, notes of 2000 at most; unknown decisions raise. With ``path`` they are appended to the table there."""
    known = decisions.withColumn("decision", F.when(F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("unknown decision "), F.coalesce("decision", F.lit("null"))))))
    kept = known.withColumns({"reviewer_name": F.substring(F.trim(F.regexp_replace("reviewer_name", r"[\x00-\x1f\x7f]", "")), 1, 100), "notes": F.substring("notes", 1, 2000)})
    if path:
        kept.write.mode("append").parquet(path)
    return kept


def latest(decisions: DataFrame) -> DataFrame:
    """The decision with the highest seq of each entry; combined before the shuffle."""
    one = F.struct("decision", "modified_payload", "reviewer_name", "notes")
    return decisions.groupBy("entry_id").agg(F.max_by(one, "seq").alias("latest"), F.count("*").alias("n_decisions"))


def history(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("seq", "decision", "reviewer_name", "notes"))).alias("history"))


def flagged(entries: DataFrame, decisions: DataFrame | None = None, threshold: float = 70) -> DataFrame:
    """Entries whose confidence is below ``threshold`` or missing, that need review or have no payload; with ``decisions`` also what was decided before."""
    low = (F.coalesce("normalization_confidence", F.lit(0.0)) < threshold) | F.coalesce("review_needed", F.lit(False)) | (F.coalesce(F.size("normalized_payload"), F.lit(0)) <= 0)
    out = entries.where(low)
    return out if decisions is None else out.join(history(decisions), "entry_id", "left")


def final_payloads(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """``entries`` with decision, n_decisions and final_payload: the modified one, for approved ones that or the original, for rejected ones none."""
    j = entries.join(latest(decisions), "entry_id", "left")
    d, own = F.col("latest.decision"), F.col("normalized_payload")
    changed = F.col("latest.modified_payload")
    final = F.when(d == "rejected", F.expr("cast(map() as map<string,string>)")).when(d == "modified", F.coalesce(changed, own)).when(d == "approved", F.when(F.size(changed) > 0, changed).otherwise(own)).otherwise(own)
    return j.withColumns({"decision": d, "final_payload": final, "n_decisions": F.coalesce("n_decisions", F.lit(0))}).drop("latest")


def review_statistics(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    j = entries.select("entry_id").join(latest(decisions), "entry_id", "left")
    s = j.agg(F.count("*").alias("total"), F.count_if(F.col("latest").isNotNull()).alias("reviewed"), F.count_if(F.col("latest.decision") == "approved").alias("approved"))
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return s.select("total", "reviewed", (F.col("total") - F.col("reviewed")).alias("pending"), "approved", F.when(F.col("reviewed") > 0, 100 * (1 - rate(F.col("approved"), F.col("reviewed")))).otherwise(0.0).alias("rejection_rate"), (100 * rate(F.col("reviewed"), F.col("total"))).alias("completion_rate"))


def review_summary(entries: DataFrame, threshold: float = 70) -> DataFrame:
    """(event_type, total, flagged, and the bands of confidence) for each event type."""
    c = F.coalesce("normalization_confidence", F.lit(0.0))
    low = (c < threshold) | F.coalesce("review_needed", F.lit(False)) | (F.coalesce(F.size("normalized_payload"), F.lit(0)) <= 0)
    return entries.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(low).alias("flagged"), F.count_if(c < 50).alias("band_0_50"), F.count_if((c >= 50) & (c < 70)).alias("band_50_70"), F.count_if((c >= 70) & (c < 85)).alias("band_70_85"), F.count_if(c >= 85).alias("band_85_100"))


def most_flagged(summary: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` event types with the most flagged entries, of equal ones the first by name."""
    return summary.where("flagged > 0").orderBy(F.desc("flagged"), "event_type").limit(k)


def split_reviewed(entries: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reviewed, pending): entries with a decision and those without."""
    known = latest(decisions).select("entry_id")
    return entries.join(known, "entry_id", "left_semi"), entries.join(known, "entry_id", "left_anti")


def export_reviewed(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    return final_payloads(entries, decisions).join(history(decisions), "entry_id", "left")
