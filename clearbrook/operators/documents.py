"""Documents: cleanup, abbreviations, spelling, measurements, codes, sections, entities and the tables made of them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.dates import iso_date
from clearbrook.functions.names import set_aside, unused, worked_out
from clearbrook.functions.text import PART, beyond_ascii, breaks, cut_at, dictionary_replaced, holds_any, let, terms_at, word_count
from clearbrook.functions.values import DISEASES, DRUGS, MEASUREMENTS, PROCEDURES, TEXT_ABBREVIATIONS, TEXT_MISSPELLINGS
from clearbrook.operators.privacy import redact_text, spans

#: Characters repaired, patterns of codes and headings, section words that confirm an entity, units.
ARTEFACTS = {"’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "é": "e", "è": "e", "ü": "u", "ö": "o", "ä": "a", "\ufffd": "", "\ufeff": ""}
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "..."}
ICD10, CPT = r"\b[A-Z]\d{2}(?:\.\d{1,4})?\b", r"(?i)(?:CPT|procedure|code)[:\s#]*(\d{5})\b"
ENTITY_WORDS = {"DISEASE": DISEASES, "DRUG": DRUGS, "PROCEDURE": PROCEDURES}
CONFIRMING = {
    "DISEASE": ["diagnosis", "diagnos", "condition", "history", "assessment", "impression", "problem", "comorbid"],
    "DRUG": ["medication", "medic", "drug", "rx", "prescription", "treatment", "therapy", "pharmacol"],
    "PROCEDURE": ["procedure", "intervention", "surgery", "operation", "test", "exam", "laboratory", "imaging"],
}
METRICS = {"BMI": (r"(?i)BMI\D*(\d+\.?\d*)\s*(\d+\.?\d*)?\s*(kg/m2|kg/m\^2)?", "bmi_unit"), "HbA1c": (r"(?i)HBA1C\D*(\d+\.?\d*)%\s*(?:and|to)?\s*(\d+\.?\d*)?%?()", "percent")}
DATE = r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4})\b"
#: A heading line: marked by #, in capitals, in capitals with a title after a colon, or numbered. Its last group is the heading.
HEADING = r"(?md)^[^\S\n]*(?:#{1,6}[^\S\n]+(.+?)|([A-Z][A-Z&/\-[^\S\n]]{3,}):|([A-Z][A-Z&/\-[^\S\n]]{2,}[A-Z&/\-])|[A-Z][A-Z&/\-[^\S\n]]{3,}:[^\S\n]*(.+?)|\d+\.[^\S\n]+([A-Z].+?))[^\S\n]*$"
#: Control characters one by one, which Java looks up in a table, unlike ranges; and what an ASCII text with white space to be normalised holds.
CONTROL = "[" + "".join(f"\\x{i:02x}" for i in [*range(9), 11, 12, *range(14, 32), *range(127, 160)]) + "]"
UNEVEN = ["  ", "\t", "\r", "\x0b", "\x0c"]
CLEANING = ["remove_control_chars", "fix_encoding_artifacts", "normalize_unicode", "normalize_whitespace", "normalize_line_breaks", "remove_empty_lines", "fix_hyphenation", "standardize_punctuation"]


@cache
def _nfkc_udf():  # noqa: ANN202  made on first use: it needs a session
    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return nfkc


def nfkc(x: Column) -> Column:
    """Unicode NFKC, which no built-in function has; one Arrow batch at a time."""
    return _nfkc_udf()(x)


def _swap(x: Column, table: dict[str, str]) -> Column:
    one = {k: v for k, v in table.items() if len(v) == 1}
    x = F.translate(x, "".join([*one, *[k for k, v in table.items() if not v]]), "".join(one.values()))
    for k, v in table.items():
        if len(v) > 1:
            x = F.replace(x, F.lit(k), F.lit(v))
    return x


def cleaning_step(x: Column, name: str) -> Column:
    return {
        "remove_control_chars": lambda: F.regexp_replace(x, CONTROL, ""),
        "fix_encoding_artifacts": lambda: F.when(beyond_ascii(x), _swap(x, ARTEFACTS)).otherwise(x),
        "normalize_unicode": lambda: F.when(beyond_ascii(x), nfkc(F.when(beyond_ascii(x), x))).otherwise(x),
        "normalize_whitespace": lambda: F.when(beyond_ascii(x) | holds_any(x, UNEVEN), F.regexp_replace(x, r"(?U)[^\S\n]+", " ")).otherwise(x),
        "normalize_line_breaks": lambda: F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")),
        "remove_empty_lines": lambda: F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x),
        "fix_hyphenation": lambda: F.when(x.contains("-\n"), F.regexp_replace(x, r"(?U)(\w+)-\n(\w+)", "$1$2")).otherwise(x),
        "standardize_punctuation": lambda: F.when(beyond_ascii(x), _swap(x, PUNCTUATION)).otherwise(x),
    }[name]()


#: Columns that cleaning adds.
CLEANED = ["cleaned", "changes", "size_reduction_pct"]


def clean_documents(df: DataFrame, text: str = "text", steps: list[str] | None = None) -> DataFrame:
    """``df`` with cleaned, changes (characters that a step has taken; for the two that repair characters and for hyphens, how many it has repaired) and size_reduction_pct. Nulls stay null. Input columns named like an output stay as ``<name>_in``."""
    steps = CLEANING if steps is None else [s for s in CLEANING if s in steps]
    df = set_aside(df, CLEANED)
    text = text if text in df.columns else f"{text}_in"
    names = unused([*df.columns, *CLEANED], *["_s"] * (len(steps) + 1))
    df = df.withColumn(names[0], F.col(text))
    for i, s in enumerate(steps):
        df = df.withColumn(names[i + 1], cleaning_step(F.col(names[i]), s))
    held = lambda i, table: F.when(beyond_ascii(F.col(names[i])), F.length(names[i]) - F.length(F.translate(F.col(names[i]), "".join(table), ""))).otherwise(F.length(names[i]) - F.length(names[i]))
    repaired = {"fix_encoding_artifacts": lambda i: held(i, ARTEFACTS), "standardize_punctuation": lambda i: held(i, PUNCTUATION), "fix_hyphenation": lambda i: F.regexp_count(F.col(names[i]), F.lit(r"(?U)(\w+)-\n(\w+)"))}
    count = lambda i, s: repaired.get(s, lambda i: F.length(names[i]) - F.length(names[i + 1]))(i)
    taken = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), count(i, s))]) if steps else F.expr("cast(map() as map<string,int>)")
    last = F.col(names[-1])
    return df.withColumns({"cleaned": last, "changes": taken, "size_reduction_pct": F.round(100.0 * (1 - F.length(last) / F.greatest(F.length(text), F.lit(1))), 2)}).drop(*names)


def strip_rtf(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\[a-z]+\d*\s?", ""), r"[{}]", "")


LONG_FORMS = {k: f"{v} ({k.upper()})" for k, v in TEXT_ABBREVIATIONS.items()}


def expand_abbreviations(x: Column) -> Column:
    """``BP`` becomes ``Blood Pressure (BP)``."""
    return dictionary_replaced(x, LONG_FORMS)["text"]


def fix_spelling(x: Column) -> Column:
    return dictionary_replaced(x, TEXT_MISSPELLINGS)["text"]


def measurements(text: Column) -> Column:
    """array of struct(measurement, value, value2, unit, position): value2 is the diastolic pressure."""
    none = F.expr("cast(array() as array<struct<measurement:string,value:double,value2:double,unit:string,position:int>>)")
    rows = {n: F.transform(spans(text, p, 1, 2), _measured(n, n == "blood_pressure")) for n, p in measurement_patterns().items()}
    return let(F.lower(text), lambda low: F.concat(*[F.when(holds_any(low, measurement_words()[n]), r).otherwise(none) for n, r in rows.items()]))


def measurement_count(text: Column) -> Column:
    """The size of ``measurements``, without what they say."""
    counts = {n: F.regexp_count(text, F.lit(p)) for n, p in measurement_patterns().items()}
    return let(F.lower(text), lambda low: reduce(lambda a, b: a + b, [F.when(holds_any(low, measurement_words()[n]), c).otherwise(0) for n, c in counts.items()]))


@cache
def measurement_patterns() -> dict[str, str]:
    """The pattern of each measurement with its unit: group 1 is the value, group 2 the unit or the diastolic pressure. It is tried only at letters that one of its words begins with."""
    units = {"temperature": r"\s*(°?\s?[FC])?", "weight": r"\s*(kg|lbs?)?", "glucose": r"\s*(mg/dL|mmol/L)?", "creatinine": r"\s*(mg/dL|umol/L|µmol/L)?"}
    first = {n: "".join(sorted({w[0] for w in words})) for n, words in measurement_words().items()}
    return {n: f"(?i)(?=[{first[n]}])" + (p if n == "blood_pressure" else f"{_value_part(p)}{units.get(n, '()')}") for n, p in MEASUREMENTS.items()}


@cache
def measurement_words() -> dict[str, list[str]]:
    """What each measurement's pattern begins with, in small letters: a text that holds none of it has no such measurement."""
    names = {n: re.match(r"\(\?:([^()]+)\)\[", p)[1].split("|") for n, p in MEASUREMENTS.items()}
    return {n: sorted({re.match(r"\w+", w)[0].lower() for w in words}) for n, words in names.items()}


def _measured(name: str, two: bool) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(name).alias("measurement"), s["g1"].try_cast("double").alias("value"), (s["g2"].try_cast("double") if two else F.lit(None).cast("double")).alias("value2"), (F.lit(None).cast("string") if two else F.nullif(s["g2"], F.lit(""))).alias("unit"), s["start"].alias("position"))


def _value_part(pattern: str) -> str:
    """A measurement pattern up to the end of its first capturing group."""
    depth, start = 0, None
    for i, ch in enumerate(pattern):
        if ch == "(":
            if start is None and pattern[i + 1] != "?":
                start = depth
            depth += 1
        elif ch == ")":
            depth -= 1
            if start is not None and depth == start:
                return pattern[: i + 1]
    return pattern


def standard_unit(measurement: Column, value: Column, unit: Column) -> Column:
    """struct(value, unit): Fahrenheit to Celsius (said so or over 50), pounds to kg, mmol/L and µmol/L to mg/dL."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    pair = lambda v, name: F.struct(v.alias("value"), F.lit(name).alias("unit"))
    return (
        F.when(measurement == "temperature", pair(F.round(F.when(u.contains("f") | (value > 50), (value - 32) * 5 / 9).otherwise(value), 1), "°C"))
        .when(measurement == "weight", pair(F.round(F.when(u.contains("lb") | u.contains("pound"), value * 0.453592).otherwise(value), 1), "kg"))
        .when(measurement == "glucose", pair(F.round(F.when(u.contains("mmol"), value * 18.0).otherwise(value), 1), "mg/dL"))
        .when(measurement == "creatinine", pair(F.round(F.when(u.rlike("[uµ]mol"), value / 88.4).otherwise(value), 2), "mg/dL"))
        .when(measurement == "blood_pressure", pair(F.round(value, 0), "mmHg"))
        .when(measurement == "heart_rate", pair(F.round(value, 0), "bpm"))
        .when(measurement.isin("oxygen_saturation", "hba1c"), pair(F.round(value, 1), "%"))
        .when(measurement == "bmi", pair(F.round(value, 1), "kg/m²"))
        .otherwise(F.struct(value.alias("value"), F.coalesce(unit, F.lit("")).alias("unit")))
    )


def icd10_codes(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=[A-Z]\d){ICD10}"), F.lit(0))))


def cpt_codes(text: Column) -> Column:
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(CPT), F.lit(1))))


def known_terms() -> dict[str, list[tuple[str, int]]]:
    """For each term in small letters the concepts that a place where it is the longest holds, with the lengths of their terms: its own and those of terms it begins with."""
    concepts: dict[str, list[str]] = {}
    for k, v in TEXT_ABBREVIATIONS.items():
        for term in (k, v):
            concepts.setdefault(term.lower(), []).append(v)
    for v in sorted(set(TEXT_MISSPELLINGS.values())):
        concepts.setdefault(v.lower(), []).append(v[:1].upper() + v[1:])
    begins = lambda t, u: t.startswith(u) and not (t[len(u) : len(u) + 1].isalnum() or t[len(u) : len(u) + 1] == "_")
    return {t: sorted({(c, len(u)) for u, cs in concepts.items() if begins(t, u) for c in cs}) for t in concepts}


def mentions(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, concept, matched_text, position) of every abbreviation, its long form and every known term; one for each concept and 50 characters, the first."""
    terms = known_terms()
    held = F.create_map(*[x for t, cs in terms.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(n).alias("n")) for c, n in cs]))])

    def concepts(s: Column) -> Column:
        one = lambda c: F.struct(c["concept"].alias("concept"), F.substring(s["match"], F.lit(1), c["n"]).alias("matched_text"), s["position"].alias("position"))
        return F.transform(F.element_at(held, F.lower(F.upper(s["match"]))), one)

    each = df.select(F.col(key), F.explode(F.flatten(F.transform(terms_at(F.col(text), list(terms)), concepts))).alias("m")).select(key, "m.*")
    (bucket,) = unused([key], "_b")
    first = each.groupBy(key, "concept", F.floor(F.col("position") / 50).alias(bucket)).agg(F.min(F.struct("position", "matched_text")).alias("m"))
    return first.select(key, "concept", "m.matched_text", "m.position")


def sections(text: Column) -> Column:
    """array of struct(section_id, heading, line_start, start, content, word_count); text before the first heading belongs to none. One run of the heading pattern cuts the text, one fold over the pieces adds lines and offsets up."""
    bare = lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    none = F.expr("cast(array() as array<struct<heading:string,line_start:int,start:int>>)")

    def step(a: Column, x: Column) -> Column:
        whole = F.when(a["inside"], F.substring_index(x, PART, 1)).otherwise(x)
        head = F.struct(F.trim(F.replace(F.substring(x, F.length(F.substring_index(x, PART, 1)) + 1, F.length(x)), F.lit(PART), F.lit(""))).alias("heading"), a["line"].alias("line_start"), a["at"].alias("start"))
        return F.struct((a["at"] + F.length(whole)).alias("at"), (a["line"] + breaks(whole)).alias("line"), (~a["inside"]).alias("inside"), F.when(a["inside"], F.concat(a["out"], F.array(head))).otherwise(a["out"]).alias("out"))

    def section(h: Column, k: Column, body: Column) -> Column:
        content = bare(F.array_join(F.filter(F.split(body, "\n"), lambda x: bare(x) != ""), "\n"))
        named = lambda c: F.struct(F.concat(F.lit("SEC-"), F.lpad((k + 1).cast("string"), 3, "0")).alias("section_id"), h["heading"].alias("heading"), h["line_start"].alias("line_start"), h["start"].alias("start"), c.alias("content"), word_count(c).alias("word_count"))
        return let(content, named)

    def of(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(False).alias("inside"), none.alias("out"))
        return F.transform(F.aggregate(pieces, start, step, lambda a: a["out"]), lambda h, k: section(h, k, F.get(pieces, 2 * k + 2)))

    return let(cut_at(text, HEADING, 1, 2, 3, 4, 5), of)


def section_count(text: Column) -> Column:
    """The size of ``sections``."""
    return F.regexp_count(text, F.lit(HEADING))


def section_at(found: Column, position: Column) -> Column:
    """The last section that starts at or before a position."""
    return F.try_element_at(F.filter(found, lambda s: s["start"] <= position), F.lit(-1))


def _alternatives(words: list[str]) -> str:
    """The words as one alternation, those with the same first letter together and among them those with the same second; words that can match at one place keep their order."""
    plain = lambda w: w[:2].isalpha() and w[2:3] not in ("?", "*")
    if not all(map(plain, words)):
        return "|".join(words)
    by: dict[str, dict[str, list[str]]] = {}
    for w in words:
        by.setdefault(w[0].lower(), {}).setdefault(w[1].lower(), []).append(w[2:])
    one = lambda ends: ends[0] if len(ends) == 1 else f"(?:{'|'.join(ends)})"
    return f"(?=[{''.join(by)}])(?:{'|'.join(a + one([b + one(ends) for b, ends in below.items()]) for a, below in by.items())})"


def _named(text: Column, kind: str) -> Column:
    """The places of a text that name an entity of a kind."""
    return F.filter(spans(text, _entity_pattern(kind)), lambda s: F.length(F.trim(s["match"])) >= 3)


@cache
def _entity_pattern(kind: str) -> str:
    return rf"(?i)\b(?:{_alternatives(ENTITY_WORDS[kind])})\b"


def entity_count(text: Column) -> Column:
    """The size of ``entity_array``, for which no section is needed, and places only where a text has a name more than once."""
    place = lambda s: F.struct(F.lower(s["match"]).alias("l"), F.floor(s["start"] / 200).alias("b"))

    def of(kind: str) -> Column:
        names = F.transform(F.filter(F.regexp_extract_all(text, F.lit(_entity_pattern(kind)), F.lit(0)), lambda m: F.length(F.trim(m)) >= 3), lambda m: F.lower(m))
        placed = F.size(F.array_distinct(F.transform(_named(text, kind), place)))
        return let(names, lambda m: F.when(F.size(F.array_distinct(m)) == F.size(m), F.size(m)).otherwise(placed))

    return reduce(lambda a, b: a + b, map(of, ENTITY_WORDS))


def entity_array(text: Column, found: Column) -> Column:
    """array of struct(type, text, start, section_id, section, confidence, context) of a text and its sections: diseases, drugs and procedures; one for each name and 200 characters. Confidence is 0.95 where the section confirms the type, else 0.80."""

    def entity(kind: str, s: Column) -> Column:
        def at(sec: Column) -> Column:
            heading = F.coalesce(sec["heading"], F.lit(""))
            sure = F.lower(heading).rlike("|".join(CONFIRMING[kind]))
            from_ = F.greatest(F.lit(0), s["start"] - 50)
            context = F.trim(F.substring(text, from_ + 1, s["end"] + 50 - from_))
            return F.struct(
                F.lit(kind).alias("type"), F.lower(s["match"]).alias("l"), F.floor(s["start"] / 200).alias("b"), s["start"].alias("start"), s["match"].alias("text"),
                F.coalesce(sec["section_id"], F.lit("")).alias("section_id"), heading.alias("section"), F.when(sure, 0.95).otherwise(0.80).alias("confidence"), context.alias("context"),
            )

        return let(section_at(found, s["start"]), at)

    of = lambda k: lambda s: entity(k, s)
    every = F.concat(*[F.transform(_named(text, k), of(k)) for k in ENTITY_WORDS])
    same = lambda a, b: F.coalesce((a["type"] == b["type"]) & (a["l"] == b["l"]) & (a["b"] == b["b"]), F.lit(False))
    first = lambda arr: F.filter(arr, lambda e, i: (i == 0) | ~same(e, F.get(arr, i - 1)))
    return F.transform(let(F.array_sort(every), first), lambda e: F.struct(*[e[n].alias(n) for n in ("type", "text", "start", "section_id", "section", "confidence", "context")]))


def entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, type, confidence, start, section_id, section, context) of ``entity_array``, a row for each. Nothing is shuffled."""
    found = let(sections(F.col(text)), lambda sec: entity_array(F.col(text), sec))
    return df.select(F.col(key), F.explode(found).alias("e")).select(key, "e.text", "e.type", "e.confidence", "e.start", "e.section_id", "e.section", "e.context")


def entity_table(found: DataFrame, key: str) -> DataFrame:
    """Mentions, confidence of the first and up to three contexts of each name, type and section."""
    return found.groupBy(key, "text", "type", "section").agg(F.count("*").alias("mentions"), F.min_by("confidence", "start").alias("confidence"), F.array_join(F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("start", "context"))), lambda x: x["context"])), 1, 3), " | ").alias("contexts"))


def vitals_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, measurement, raw_value, raw_unit, value, unit, position), systolic and diastolic pressure in rows of their own."""
    one = lambda m, name, v, unit: F.struct(name.alias("measurement"), m["measurement"].alias("of"), v.alias("raw_value"), unit.alias("raw_unit"), m["position"].alias("position"))
    none = F.lit(None).cast("string")
    rows = F.flatten(F.transform(measurements(F.col(text)), lambda m: F.when(m["measurement"] == "blood_pressure", F.array(one(m, F.lit("blood_pressure_systolic"), m["value"], none), one(m, F.lit("blood_pressure_diastolic"), m["value2"], none))).otherwise(F.array(one(m, m["measurement"], m["value"], m["unit"])))))
    each = df.select(F.col(key), F.explode(rows).alias("m")).select(key, "m.*")
    return each.withColumn("_s", standard_unit(F.col("of"), F.col("raw_value"), F.col("raw_unit"))).select(key, "measurement", "raw_value", "raw_unit", F.col("_s.value").alias("value"), F.col("_s.unit").alias("unit"), "position")


def _range_of(metric: str, unit: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(metric).alias("metric"), s["g1"].alias("value_low"), F.coalesce(s["g2"], F.lit("")).alias("value_high"), F.lit(unit).alias("unit"), F.substring(F.trim(F.regexp_replace(s["match"], r"\s+", " ")), 1, 140).alias("raw_reference"), s["start"].alias("start"))


def metric_array(text: Column) -> Column:
    """array of struct(metric, value_low, value_high, unit, raw_reference, start): ranges of BMI and HbA1c."""
    return F.concat(*[F.transform(spans(text, p, 1, 2), _range_of(n, u)) for n, (p, u) in METRICS.items()])


def metric_count(text: Column) -> Column:
    """The size of ``metric_array``."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p, _ in METRICS.values()])


def metrics_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, metric, value_low, value_high, unit, raw_reference, section_id, section) of ``metric_array``."""
    placed = let(sections(F.col(text)), lambda sec: F.transform(metric_array(F.col(text)), lambda m: F.struct(m.alias("m"), section_at(sec, m["start"]).alias("at"))))
    each = df.select(F.col(key), F.explode(placed).alias("x"))
    return each.select(key, "x.m.metric", "x.m.value_low", "x.m.value_high", "x.m.unit", "x.m.raw_reference", F.coalesce("x.at.section_id", F.lit("")).alias("section_id"), F.coalesce("x.at.heading", F.lit("")).alias("section"))


def timeline_table(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, date, iso_date, section, context): dates in sections, each once for a section."""
    each = df.select(F.col(key), F.explode(sections(F.col(text))).alias("s")).select(key, "s.heading", "s.content")
    each = each.select(key, "heading", "content", F.explode(spans(F.col("content"), DATE)).alias("d"))
    from_ = F.greatest(F.lit(0), F.col("d.start") - 60)
    each = each.select(key, F.col("d.match").alias("date"), F.col("heading").alias("section"), F.col("d.start").alias("_at"), F.trim(F.substring("content", from_ + 1, F.col("d.end") + 60 - from_)).alias("context"))
    first = each.groupBy(key, "date", "section").agg(F.min_by("context", "_at").alias("context"))
    return first.select(key, "date", iso_date(F.col("date")).alias("iso_date"), "section", "context")


#: Issues that a quality report names, and the grades.
FEW_TYPED = "Only a subset of log events were normalized into typed clinical records."
NO_SIGNAL = "No clinical measurements or normalized clinical events were extracted."


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").otherwise("D")


#: The counts of ``process_documents``, in its order.
COUNTS = [f"n_{n}" for n in ("abbreviations", "spelling", "findings", "values", "sections", "entities", "metrics", *[f"{n}_{side}" for side in ("in", "out") for n in ("chars", "words", "lines")])]


def process_documents(df: DataFrame, text: str = "text", style: str = "tag", columns: list[str] | None = None) -> DataFrame:
    """``df`` cleaned, expanded, spelled right, redacted and read: one row for each document, no shuffle.

    Measurements, codes, sections, entities and metrics come from the text before redaction. n_... count what was
    found and changed; quality_report adds scores. Null texts have nulls and empty lists; clashing columns are replaced.
    ``columns``: the outputs that are wanted, all if there are none named. What none of them needs isn't worked out, and
    things of which only the number is wanted are counted without being described.
    """
    given = set_aside(df, CLEANED).columns
    want = lambda *names: columns is None or not set(names).isdisjoint(columns)
    df = clean_documents(df, text)
    expanded, right = unused(df.columns, "_long", "_right")
    df = worked_out(df, {expanded: dictionary_replaced(F.col("cleaned"), LONG_FORMS)})
    df = worked_out(df, {right: dictionary_replaced(F.col(f"{expanded}.text"), TEXT_MISSPELLINGS)})
    df = worked_out(df, {"edited": F.col(f"{right}.text"), "n_abbreviations": F.col(f"{expanded}.n"), "n_spelling": F.col(f"{right}.n")}).drop(expanded, right)
    df = redact_text(df, "edited", style)
    edited = F.col("edited")
    if want("sections", "entities"):
        df = worked_out(df, {"sections": sections(edited)})
    found = {"clinical_values": measurements(edited), "icd10": icd10_codes(edited), "cpt": cpt_codes(edited), "metrics": metric_array(edited), "entities": let(F.col("sections"), lambda sec: entity_array(edited, sec))}
    found = {n: c for n, c in found.items() if want(n)}
    df = worked_out(df, found) if found else df
    number = {"values": ("clinical_values", measurement_count), "sections": ("sections", section_count), "entities": ("entities", entity_count), "metrics": ("metrics", metric_count)}
    counts = {"n_findings": F.size("findings")} | {f"n_{n}": F.size(c) if want(c) else count(edited) for n, (c, count) in number.items()}
    for name, c in (("in", text), ("out", "redacted")):
        counts |= {f"n_chars_{name}": F.length(c), f"n_words_{name}": word_count(F.col(c)), f"n_lines_{name}": breaks(F.col(c)) + 1}
    df = df.withColumns({n: c for n, c in counts.items() if want(n)})
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in given or want(c)])


def corpus_totals(processed: DataFrame) -> DataFrame:
    """One row over all rows of ``process_documents``: documents, those that passed, and the sum of every count."""
    counts = [c for c in processed.columns if c.startswith("n_")]
    return processed.agg(F.count(F.lit(1)).alias("documents"), F.count_if("passed").alias("passed"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def quality_report(processed: DataFrame, key: str, events: DataFrame | None = None) -> DataFrame:
    """(key, compliance, log_structure, clinical_coverage, document_structure, overall, grade, issues and the counts behind them) of each row of ``process_documents``.

    ``events`` are the typed events of those documents that are logs (``normalise_logs`` with the same key); a
    document without any counts as no log. Scores are 0 to 100, overall is their mean.
    """
    d = processed.select(F.col(key), "passed", F.col("issues").alias("_leaks"), "n_values", "n_sections", "n_entities")
    counts = ["entries", "structured", "normalised", "signals", "medications", "labs"]
    if events is None:
        d = d.withColumns({n: F.lit(0).cast("long") for n in counts} | {"confidence": F.lit(None).cast("double")})
    else:
        structured = F.col("event_type") != "raw_log_line"
        typed = structured & (F.coalesce(F.size("normalized_payload"), F.lit(0)) > 0)
        of = lambda *kinds: F.count_if(typed & F.col("event_type").isin(*kinds))
        g = events.groupBy(key).agg(F.count("*").alias("entries"), F.count_if(structured).alias("structured"), F.count_if(typed).alias("normalised"), of("lab_result", "medication_event", "vitals_capture").alias("signals"), of("medication_event").alias("medications"), of("lab_result").alias("labs"), F.avg(F.when(structured, F.col("parse_confidence"))).alias("confidence"))
        d = d.join(g, key, "left").fillna(0, counts)
    n, hundred = F.size("_leaks"), F.lit(100.0)
    signals = F.col("n_values") + F.col("signals")
    d = d.withColumns(
        {
            "compliance": F.when(F.col("passed"), 100.0).otherwise(F.greatest(F.lit(20.0), 100.0 - 20 * n)),
            "log_structure": F.when(F.col("entries") == 0, 100.0).otherwise(F.bround(F.least(hundred, F.coalesce("confidence", F.lit(0.0)) * 70 + F.col("normalised") / F.greatest(F.lit(1), F.col("structured")) * 30))),
            "clinical_coverage": F.least(hundred, 35.0 + 6 * signals),
            "document_structure": F.least(hundred, 40.0 + 8 * F.col("n_sections") + 2 * F.col("n_entities")),
            "issues": F.slice(F.concat("_leaks", F.filter(F.array(F.when((F.col("normalised") > 0) & (F.col("normalised") < F.greatest(F.lit(1), F.floor(F.col("structured") * 0.5))), FEW_TYPED), F.when(signals == 0, NO_SIGNAL)), lambda x: x.isNotNull())), 1, 6),
        }
    )
    d = d.withColumn("overall", F.bround((F.col("compliance") + F.col("log_structure") + F.col("clinical_coverage") + F.col("document_structure")) / 4))
    return d.select(key, "compliance", "log_structure", "clinical_coverage", "document_structure", "overall", grade(F.col("overall")).alias("grade"), "issues", "structured", "normalised", "medications", "labs", F.col("n_values").alias("measurements"), F.col("n_entities").alias("entities"))
