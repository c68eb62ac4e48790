"""Identifiers in tables and in text: detection, redaction, quality of the redaction."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.names import unused, worked_out
from clearbrook.functions.text import PART, breaks, cut_at, holds_any, let
from clearbrook.functions.values import PHI_PATTERNS
from clearbrook.operators.stats import kind_of

#: Tabular patterns in order, name parts of identifying columns, weights of overlapping findings.
COLUMN_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "phone_in": r"\b[6-9]\d{9}\b",
    "phone_in_spaced": r"\b[6-9]\d{4}[\s-]\d{5}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "aadhaar": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "hospital_id": r"\b(?:MRN|HID|PAT|UHID)[-.\s]?\d{4,10}\b",
}
COLUMN_WORDS = [
    "name", "patient_name", "first_name", "last_name", "full_name", "address", "street", "city", "zip", "pincode", "postal",
    "phone", "mobile", "contact", "telephone", "cell", "email", "e_mail", "email_address",
    "ssn", "social_security", "aadhaar", "aadhar", "uid", "mrn", "patient_id", "medical_record", "uhid", "hospital_id",
    "dob", "date_of_birth", "birth_date", "insurance_id", "policy_number", "beneficiary",
]
RISK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SPECIFIC = {"MRN": 5, "INSURANCE_ID": 5, "NPI": 5, "DOB": 5, "PATIENT_NAME": 4, "PROVIDER_NAME": 4, "SSN": 3, "AADHAAR": 3, "CREDIT_CARD": 3, "PHONE": 2, "EMAIL": 2, "DATE_FULL": 1}
LEAKS = [
    (r"\*{3}-\*{2}-\d{4}\b", "CRITICAL: Partial SSN still visible"),
    (r"(?=\d{3}[-\d])(?<![A-Za-z0-9-])(?:\d{3}-\d{2}-\d{4}|\d{9})(?![A-Za-z0-9-])", "CRITICAL: Unredacted SSN still visible"),
    (r"\[REDACTED-[^\]]+\]-[^\s\[]+", "CRITICAL: Malformed redaction marker detected"),
    (r"TED-PHONE\]", "CRITICAL: Truncated redaction marker detected"),
    (r"\b(?:DOB|Date of Birth)[:\s]*\d{4}[-/]\d{2}[-/]\d{2}\b", "HIGH: Date of birth still visible"),
    (r"\b(?:DOB|Date of Birth)[:\s]*\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", "HIGH: Date of birth still visible"),
]
NINE_DIGITS = ("SSN", "AADHAAR", "CREDIT_CARD")
#: Types whose pattern asks for no digit (or mask); texts without one aren't searched for the others.
WITHOUT_DIGITS = ("EMAIL", "INSURANCE_ID", "PATIENT_NAME", "PROVIDER_NAME")
#: What a text in small letters must hold for a type's pattern to match at all; the long numbers also ask for ``LONG_NUMBER``, or a mask.
NEEDED = {
    "MRN": ["mrn", "medical record"], "EMAIL": ["@"], "DOB": ["dob", "date of birth"], "DATE_FULL": ["/", "-"], "IP_ADDRESS": ["."], "NPI": ["npi"], "INSURANCE_ID": ["policy", "insurance", "member", "group"],
    "PATIENT_NAME": ["patient", "name"], "PROVIDER_NAME": ["dr.", "doctor", "physician", "attending", "provider"],
}
LONG_NUMBERS, LONG_NUMBER, MASKS = ("SSN", "PHONE", "CREDIT_CARD", "AADHAAR"), r"\d{2}[-.\s]?\d{4}", ["***-**-", "xxx-xx-"]
#: The mail pattern, tried only where its first part can begin: at the end of the last match, or where no character of it is before.
_LOCAL = "[" + string.ascii_letters + string.digits + r"._%+\-]"
QUICK = {"EMAIL": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}"}
LEAKS_NEED = [["***-**-"], None, ["[redacted-"], ["ted-phone]"], ["dob", "date of birth"], ["dob", "date of birth"]]


def identifying(name: str, whole_word: bool = False) -> bool:
    n = name.lower().replace(" ", "_")
    return any(w in n for w in COLUMN_WORDS) if not whole_word else any(re.search(rf"(?:^|_){w}(?:_|$)", n) for w in COLUMN_WORDS)


def redact_columns(df: DataFrame, whole_word: bool = False) -> DataFrame:
    """Columns whose name says that they identify become ``[REDACTED_PHI]``, nulls too; in other string columns each pattern is replaced in turn."""
    new = {}
    for c in df.columns:
        if identifying(c, whole_word):
            new[c] = F.lit("[REDACTED_PHI]")
        elif kind_of(df, c) == "string":
            x = F.col(f"`{c}`")
            for name, p in COLUMN_PATTERNS.items():
                x = F.regexp_replace(x, f"(?i){p}", f"[REDACTED_{name.upper()}]")
            new[c] = x
    return df.withColumns(new)


def column_redactions(df: DataFrame, whole_word: bool = False) -> DataFrame:
    """(column, kind, values): how many values each redaction changes, from one pass."""
    rows = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        if identifying(c, whole_word):
            rows.append(F.struct(F.lit(c).alias("column"), F.lit("column").alias("kind"), F.count(x).alias("values")))
        elif kind_of(df, c) == "string":
            for name, p in COLUMN_PATTERNS.items():
                rows.append(F.struct(F.lit(c).alias("column"), F.lit(name).alias("kind"), F.count_if(x.rlike(f"(?i){p}")).alias("values")))
                x = F.regexp_replace(x, f"(?i){p}", f"[REDACTED_{name.upper()}]")
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).where("values > 0")


def spans(text: Column, pattern: str, *groups: int) -> Column:
    """array of struct(start, end, match, g1...): every match of a pattern with its offsets (from 0), from one run of the pattern."""
    names = "".join(f",g{g}:string" for g in groups)
    none = F.expr(f"cast(array() as array<struct<start:int,end:int,match:string{names}>>)")

    def step(a: Column, x: Column) -> Column:
        def met(parts: Column) -> Column:
            end = a["at"] + F.length(parts[0])
            found = F.struct(a["at"].alias("start"), end.alias("end"), parts[0].alias("match"), *[F.get(parts, F.lit(i)).alias(f"g{g}") for i, g in enumerate(groups, 1)])
            return F.struct(end.alias("at"), F.lit(False).alias("inside"), F.concat(a["out"], F.array(found)).alias("out"))

        return F.when(a["inside"], let(F.split(x, PART, -1), met)).otherwise(F.struct((a["at"] + F.length(x)).alias("at"), F.lit(True).alias("inside"), a["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))
    folded = lambda p: F.when(F.size(p) > 1, F.aggregate(p, start, step, lambda a: a["out"])).otherwise(none)
    return F.coalesce(let(cut_at(text, pattern, *groups), folded), none)


FINDING = "array<struct<start:int,end:int,match:string,type:string,hipaa_category:string,risk_level:string,specificity:int,risk:int>>"


def what_it_holds(text: Column) -> Column:
    """struct(low, digits, long): a text in small letters, whether it holds digits or a mask, and whether it holds a long number."""
    return F.struct(F.lower(text).alias("low"), text.rlike("[0-9*]|XXX-|xxx-").alias("digits"), text.rlike(LONG_NUMBER).alias("long"))


def find_identifiers(text: Column, seen: Column) -> Column:
    """All findings of a text without overlaps, by start: of two that overlap the more specific, longer, riskier one stays. ``seen`` is ``what_it_holds``, which spares a text patterns that can't match."""

    def possible(kind: str) -> Column:
        ask = [] if kind in WITHOUT_DIGITS else [seen["digits"]]
        if kind in NEEDED:
            ask.append(holds_any(seen["low"], NEEDED[kind]))
        if kind in LONG_NUMBERS:
            ask.append(seen["long"] | holds_any(seen["low"], MASKS) if kind == "SSN" else seen["long"])
        return reduce(lambda a, b: a & b, ask)

    def of(kind: str) -> Column:
        pattern, category, risk = PHI_PATTERNS[kind]
        found = F.when(possible(kind), spans(text, f"(?i){QUICK.get(kind, pattern)}")).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)"))
        if kind in NINE_DIGITS:
            enough = lambda s: F.length(F.regexp_replace(s["match"], r"\D", "")) >= 9
            found = F.filter(found, lambda s: enough(s) | s["match"].rlike("[*Xx]") if kind == "SSN" else enough(s))
        return F.transform(found, lambda s: F.struct(s["start"], s["end"], s["match"], F.lit(kind).alias("type"), F.lit(category).alias("hipaa_category"), F.lit(risk).alias("risk_level"), F.lit(SPECIFIC.get(kind, 0)).alias("specificity"), F.lit(RISK[risk]).alias("risk")))

    everything = F.concat(*[of(k) for k in PHI_PATTERNS])
    ordered = F.transform(F.sort_array(F.transform(everything, lambda f: F.struct(f["start"].alias("a"), (f["start"] - f["end"]).alias("b"), (-f["risk"]).alias("c"), f.alias("f")))), lambda x: x["f"])
    better = lambda n, o: F.struct(n["specificity"].alias("a"), (n["end"] - n["start"]).alias("b"), n["risk"].alias("c")) > F.struct(o["specificity"].alias("a"), (o["end"] - o["start"]).alias("b"), o["risk"].alias("c"))

    def fold(acc: Column, f: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (f["start"] >= last["end"]), F.concat(acc, F.array(f))).when(better(f, last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(f))).otherwise(acc)

    return F.when(text.isNull(), F.expr(f"cast(array() as {FINDING})")).otherwise(F.aggregate(ordered, F.expr(f"cast(array() as {FINDING})"), fold))


def _found(df: DataFrame, held: str, text: str) -> DataFrame:
    (seen,) = unused([*df.columns, held], "_seen")
    return worked_out(worked_out(df, {seen: what_it_holds(F.col(text))}), {held: find_identifiers(F.col(text), F.col(seen))}).drop(seen)


def with_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with findings: type, category, risk, offsets, line and a preview of three characters."""
    (held,) = unused(df.columns, "_f")
    found = _found(df, held, text)
    one = lambda f, line: F.struct(f["type"], f["hipaa_category"], f["risk_level"], f["start"], f["end"], line.alias("line_number"), F.concat(F.substring(f["match"], 1, 3), F.lit("***")).alias("preview"))

    def step(a: Column, f: Column) -> Column:
        line = a["line"] + breaks(F.substring(F.col(text), a["at"] + 1, f["start"] - a["at"]))
        return let(line, lambda n: F.struct(f["start"].alias("at"), n.alias("line"), F.concat(a["out"], F.array(one(f, n))).alias("out")))

    none = F.expr("cast(array() as array<struct<type:string,hipaa_category:string,risk_level:string,start:int,end:int,line_number:int,preview:string>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), none.alias("out"))
    return worked_out(found, {"findings": F.aggregate(held, start, step, lambda a: a["out"])}).drop(held)


def redact_text(df: DataFrame, text: str = "text", style: str = "tag") -> DataFrame:
    """``df`` with findings, redacted (style tag, hash, mask or remove), issues of the quality check, passed and compliant."""
    new = {
        "tag": lambda f: F.concat(F.lit("[REDACTED-"), f["type"], F.lit("]")),
        "hash": lambda f: F.concat(F.lit("[PSEUDO-"), f["type"], F.lit("-"), F.substring(F.sha2(f["match"], 256), 1, 12), F.lit("]")),
        "mask": lambda f: F.repeat(F.lit("*"), f["end"] - f["start"]),
        "remove": lambda f: F.lit(""),
    }[style]
    df = with_findings(df, text)
    with_match = lambda f: F.struct(f["type"].alias("type"), f["start"].alias("start"), f["end"].alias("end"), F.substring(F.col(text), f["start"] + 1, f["end"] - f["start"]).alias("match"))
    before = lambda i: F.coalesce(F.get("findings", i - 1)["end"], F.lit(0))
    parts = F.transform("findings", lambda f, i: F.concat(F.substring(F.col(text), before(i) + 1, f["start"] - before(i)), new(with_match(f))))
    rest = F.coalesce(F.element_at(F.col("findings.end"), -1), F.lit(0))
    whole = F.when(F.size("findings") == 0, F.col(text)).otherwise(F.concat(F.array_join(parts, ""), F.substring(F.col(text), rest + 1, F.length(F.col(text)))))
    masked = lambda w: F.when(w.contains("***-**-"), F.regexp_replace(w, r"\*{3}-\*{2}-\d{4}\b", "[REDACTED-SSN]")).otherwise(w)
    df = worked_out(df, {"redacted": let(whole, masked)})
    return with_leaks(df, "redacted").withColumn("compliant", (F.size("findings") > 0) & F.col("passed"))


def with_leaks(df: DataFrame, text: str) -> DataFrame:
    """issues: what the six leak patterns still see; passed if that is nothing."""
    seen = lambda p, low, need: F.col(text).rlike(f"(?i){p}") if need is None else F.when(holds_any(low, need), F.col(text).rlike(f"(?i){p}"))
    marks = lambda low: F.array(*[F.when(seen(p, low, need), m) for (p, m), need in zip(LEAKS, LEAKS_NEED, strict=True)])
    return worked_out(df, {"issues": F.filter(let(F.lower(F.col(text)), marks), lambda m: m.isNotNull())}).withColumn("passed", F.size("issues") == 0)


def finding_summary(df: DataFrame) -> DataFrame:
    """(type, hipaa_category, risk_level, findings, documents) over all rows of ``with_findings``: each text counts once for a type."""
    kinds = F.array_distinct(F.transform("findings", lambda f: F.struct(f["type"].alias("type"), f["hipaa_category"].alias("hipaa_category"), f["risk_level"].alias("risk_level"))))
    each = df.select(F.explode(F.transform(kinds, lambda k: F.struct(k["type"], k["hipaa_category"], k["risk_level"], F.size(F.filter("findings", lambda f: f["type"] == k["type"])).alias("n")))).alias("f"))
    return each.groupBy("f.type", "f.hipaa_category", "f.risk_level").agg(F.sum("f.n").alias("findings"), F.count("*").alias("documents"))


def redaction_report(df: DataFrame, style: str = "tag") -> DataFrame:
    """(style, documents, redactions, critical, high, medium, low, by_category) over all rows of ``redact_text``."""
    by = finding_summary(df).groupBy().agg(F.sum("findings").alias("redactions"), *[F.coalesce(F.sum(F.when(F.col("risk_level") == r, F.col("findings"))), F.lit(0)).alias(r.lower()) for r in RISK], F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(": ", "hipaa_category", "type"), "findings")))).alias("by_category"))
    return df.agg(F.count("*").alias("documents")).join(F.broadcast(by)).select(F.lit(style).alias("style"), "documents", F.coalesce("redactions", F.lit(0)).alias("redactions"), *[r.lower() for r in RISK], "by_category")


def identifier_values(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with names and addresses found in each text, distinct and sorted; for audits, as these identify."""
    (held,) = unused(df.columns, "_f")
    pick = lambda kinds: F.array_sort(F.array_distinct(F.transform(F.filter(held, lambda f: f["type"].isin(*kinds)), lambda f: f["match"])))
    return _found(df, held, text).withColumns({"patient_names": pick(["PATIENT_NAME"]), "provider_names": pick(["PROVIDER_NAME"]), "addresses": pick(["ADDRESS"])}).drop(held)
