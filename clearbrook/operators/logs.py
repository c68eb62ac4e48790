"""Log corpora as typed events: entries, fields, snapshots, event types, payloads, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.dates import iso_timestamp
from clearbrook.functions.names import unused
from clearbrook.functions.text import MARK, PART, field_key, holds_any
from clearbrook.functions.values import MEASUREMENTS
from clearbrook.operators.documents import ICD10, measurement_words
from clearbrook.operators.similarity import sent_if_small
from clearbrook.sources.staging import staged

#: Layout of an entry, routes, frequencies, event rules.
HEADER = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[\w+\]\s+[^:\n]+:"
ENTRY = r"(?ms)^\s*(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+([^:]+):\s*(.*?)\s*(?=^\s*\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[\w+\]\s+[^:]+:|\z)"
ROUTES = {"po": "oral", "oral": "oral", "iv": "intravenous", "im": "intramuscular", "sc": "subcutaneous", "sq": "subcutaneous", "subq": "subcutaneous", "sl": "sublingual", "pr": "rectal", "ng": "nasogastric", "peg": "peg_tube"}
FREQUENCIES = {
    "qd": "daily", "daily": "daily", "once daily": "daily", "bid": "twice_daily", "twice daily": "twice_daily", "tid": "three_times_daily", "qid": "four_times_daily",
    "qhs": "nightly", "q4h": "every_4_hours", "q6h": "every_6_hours", "q8h": "every_8_hours", "q12h": "every_12_hours", "prn": "as_needed",
}
#: event type: (required, optional, weights of required fields, of completeness, of extraction)
RULES = {
    "lab_result": (["test_name", "value", "unit"], ["abnormal_flag", "reference_range", "criticality"], (0.5, 0.3, 0.2)),
    "lab_order": (["order_set", "priority"], ["ordering_provider", "ordered_tests"], (0.5, 0.25, 0.25)),
    "medication_event": (["medication_name", "action"], ["route", "dose", "frequency", "infusion_rate"], (0.45, 0.35, 0.2)),
    "imaging_order": (["modality", "priority"], ["indication"], (0.55, 0.25, 0.2)),
    "imaging_result": (["modality", "findings"], ["impression"], (0.5, 0.3, 0.2)),
    "consult": (["specialty", "status"], ["reason", "plan", "consulting_provider"], (0.5, 0.3, 0.2)),
    "nursing_note": (["event_subtype"], ["mental_status", "pain_level", "vitals", "oxygen_support"], (0.4, 0.35, 0.25)),
    "procedure_event": (["procedure_name", "status"], ["provider", "location", "findings", "technique"], (0.5, 0.3, 0.2)),
    "post_procedure": (["patient_status"], ["hemostasis", "drain_output", "monitoring_plan"], (0.45, 0.35, 0.2)),
}
STRICT = ["lab_result", "procedure_event"]
STATES = ["stable", "alert", "recovering", "critical", "unstable", "compromised"]


def parse_entries(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, entry_id, timestamp, level, source, message, line_number): entries of ``ts [LEVEL] SOURCE: message``, over as many lines as they take; a text without any gives its non-empty lines as RAW."""
    t, e = F.col("_t"), F.col("_e")
    base = df.select(F.col(key), F.col(text).alias("_t")).where("_t is not null").withColumns({"_log": t.rlike(rf"(?m)^\s*{HEADER}"), "_lines": F.split(t, "\n")})
    # Line numbers: an entry starts on the line of its header.
    heads = F.array_compact(F.transform("_lines", lambda x, i: F.when(x.rlike(rf"^\s*{HEADER}"), i + 1)))
    # Entries follow each other without a gap, so the pattern runs once and its matches are cut apart at marks, unless the text holds marks itself.
    cut = F.transform(F.split(F.regexp_replace(t, ENTRY, f"{MARK}$1{PART}$2{PART}$3{PART}$4"), MARK, -1), lambda p: F.split(p, PART, -1))
    get = lambda g: F.regexp_extract_all(t, F.lit(ENTRY), F.lit(g))
    apart = F.transform(F.arrays_zip(get(1).alias("a"), get(2).alias("b"), get(3).alias("c"), get(4).alias("d")), lambda r: F.array(r["a"], r["b"], r["c"], r["d"]))
    found = F.when(t.contains(MARK) | t.contains(PART), apart).otherwise(F.slice(cut, F.lit(2), F.size(cut)))
    raw = F.transform("_lines", lambda x: F.array(x))
    rows = base.withColumn("_heads", F.when(F.col("_log"), heads)).select(key, "_log", "_heads", F.posexplode(F.when(F.col("_log"), found).otherwise(raw)).alias("_n", "_e"))
    rows = rows.where(F.col("_log") | e[0].rlike(r"\S"))
    said = lambda x, other: F.when(F.col("_log"), x).otherwise(other)
    return rows.select(
        key, _entry_id(F.col("_n") + 1), said(e[0], F.lit(None).cast("string")).alias("timestamp"), said(F.get(e, F.lit(1)), F.lit("RAW")).alias("level"), said(F.trim(F.get(e, F.lit(2))), F.lit("unknown")).alias("source"),
        said(F.trim(_spaced(F.get(e, F.lit(3)))), F.trim(e[0])).alias("message"), said(F.get("_heads", F.col("_n")), F.col("_n") + 1).alias("line_number"),
    )


def _spaced(x: Column) -> Column:
    """Every run of white space as one space; single spaces aren't touched."""
    return F.regexp_replace(x, r"\s{2,}|[\t-\r]", " ")


def parse_lines(lines: DataFrame) -> DataFrame:
    """The same entries from single lines: (file, entry_id, timestamp, level, source, message, line_number).

    ``lines`` has file, block (where in the file a stretch of lines begins), at (orders the lines of a block) and line. Blocks are
    worked on each by itself: their lines and headers are counted, and the counts of the blocks before give every line its number and
    its entry. An entry that is open at the end of a block goes on in the next ones, as its lines have its number. A header takes one line, and one
    after a header without a message is an entry, though indented. Lines before a file's first header belong to none; a file without any gives its non-empty lines as RAW. Null lines are empty; no lines, no entries.
    """
    head = F.coalesce(F.col("line"), F.lit("")).rlike(rf"^\s*{HEADER}")
    lines = lines.select("file", "block", "at", F.coalesce("line", F.lit("")).alias("line"), head.alias("head"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.count_if("head").alias("heads"))
    earlier = "over (partition by file order by block rows between unbounded preceding and 1 preceding)"
    before = blocks.select("file", "block", F.expr(f"coalesce(sum(lines) {earlier}, 0)").alias("lines_before"), F.expr(f"coalesce(sum(heads) {earlier}, 0)").alias("heads_before"), F.expr("sum(heads) over (partition by file) > 0").alias("log"))
    within = "over (partition by file, block order by at rows between unbounded preceding and current row)"
    numbered = lines.withColumns({"n": F.expr(f"row_number() over (partition by file, block order by at)"), "k": F.expr(f"sum(cast(head as int)) {within}")})
    placed = numbered.join(sent_if_small(staged(before, "log-blocks")), ["file", "block"])
    placed = placed.select("file", "log", (F.col("lines_before") + F.col("n")).alias("line_number"), (F.col("heads_before") + F.col("k")).alias("entry"), "line")
    each = placed.where("log and entry > 0").groupBy("file", "entry").agg(F.sort_array(F.collect_list(F.struct("line_number", "line"))).alias("parts"))
    text = F.array_join(F.col("parts.line"), "\n")
    part = lambda g: F.regexp_extract(text, rf"(?s)^\s*(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+\[(\w+)\]\s+([^:]+):(.*)", g)
    logs = each.select("file", _entry_id(F.col("entry")), part(1).alias("timestamp"), part(2).alias("level"), F.trim(part(3)).alias("source"), F.trim(F.regexp_replace(part(4), r"\s+", " ")).alias("message"), F.col("parts")[0]["line_number"].cast("int").alias("line_number"))
    raw = placed.where("not log").where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")
    raw = raw.select("file", _entry_id(F.col("line_number")), F.lit(None).cast("string").alias("timestamp"), F.lit("RAW").alias("level"), F.lit("unknown").alias("source"), F.trim("line").alias("message"), F.col("line_number").cast("int"))
    return logs.unionByName(raw)


def _entry_id(n: Column) -> Column:
    return F.concat(F.lit("LOG-"), F.when(n < 10000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))).alias("entry_id")


def inline_fields(message: Column) -> Column:
    """``a: b | c: d`` as a map; of repeated keys the first holds."""
    form = r"^([A-Za-z][A-Za-z0-9 /()#\-]{1,40}):\s*(.+)"
    parts = F.filter(F.transform(F.split(message, r"\|"), lambda s: F.trim(s)), lambda s: s.rlike(form))
    pairs = F.filter(F.transform(parts, lambda s: F.struct(field_key(F.regexp_extract(s, form, 1)).alias("key"), F.trim(F.regexp_extract(s, form, 2)).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    first = F.aggregate(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda a, p: F.when(F.exists(a, lambda q: q["key"] == p["key"]), a).otherwise(F.concat(a, F.array(p))))
    none = F.expr("cast(map() as map<string,string>)")
    return F.when(message.isNull(), F.lit(None)).when(message.contains(":"), F.map_from_entries(first)).otherwise(none)


def snapshot(message: Column, low: Column) -> Column:
    """The first value of each measurement as text, ``systolic/diastolic`` for blood pressure. ``low``: the message in small letters."""
    pairs, words = [], measurement_words()
    for name, p in MEASUREMENTS.items():
        v = F.regexp_extract(message, f"(?i){p}", 1)
        v = F.concat(v, F.lit("/"), F.regexp_extract(message, f"(?i){p}", 2)) if name == "blood_pressure" else v
        pairs.append(F.when(holds_any(low, words[name]) & message.rlike(f"(?i){p}"), F.struct(F.lit(name).alias("key"), v.alias("value"))))
    some = holds_any(low, sorted({w for ws in words.values() for w in ws}))
    return F.when(some | message.isNull(), F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))).otherwise(F.expr("cast(map() as map<string,string>)"))


def event_type(source: Column, s: Column, low: Column, m: Column, lv: Column) -> Column:
    """``s`` and ``low``: the source in large and small letters, ``m``: the message in small ones, ``lv``: the level in large ones."""
    return (
        F.when(lv == "RAW", "raw_log_line")
        .when(low.contains("triage") & m.contains("vitals"), "vitals_capture")
        .when(s == "LAB-RESULT", "lab_result").when(s == "LAB-ORDER", "lab_order").when(s == "PHARMACY", "medication_event")
        .when((s == "RADIOLOGY") & m.contains("ordered"), "imaging_order").when((s == "RADIOLOGY") & m.contains("result"), "imaging_result")
        .when(s == "CONSULT", "consult").when(low.contains("nursing"), "nursing_note")
        .when(low.rlike("post-proc|post_proc|postprocedure"), "post_procedure")
        .when((s == "EMR-SYSTEM") & m.contains("check-in"), "patient_check_in").when((s == "EMR-SYSTEM") & m.contains("priority assigned"), "triage_priority")
        .when(m.contains("critical value") | (lv == "ALERT"), "critical_alert")
        .when((m.contains("procedure") & m.contains("started")) | m.contains("completed") | m.contains("in progress"), "procedure_event")
        .otherwise(F.coalesce(F.nullif(field_key(source), F.lit("")), F.lit("log_event")))
    )


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, f"(?i){pattern}", group)), F.lit(""))


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


def route(x: Column) -> Column:
    return F.coalesce(F.element_at(_map(ROUTES), F.lower(F.trim(x))), field_key(x))


def frequency(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.coalesce(F.element_at(_map(FREQUENCIES), v), F.when(v.rlike(r"^q\d+h$"), F.concat(F.lit("every_"), F.regexp_extract(v, r"^q(\d+)h$", 1), F.lit("_hours"))), field_key(v))


def _pieces(x: Column, pattern: str, groups: int) -> Column:
    """An array with each group of a pattern that begins with ``^`` at its own number; of one element where it doesn't match. The pattern runs once."""
    own = F.array(F.lit(""), *[F.regexp_extract(x, f"(?i){pattern}", g) for g in range(1, groups + 1)])
    cut = F.split(F.regexp_replace(x, f"(?i){pattern}(?s:.*)", "".join(f"{PART}${g}" for g in range(1, groups + 1))), PART, -1)
    return F.when(x.contains(PART), F.when(x.rlike(f"(?i){pattern}"), own).otherwise(F.array(F.lit("")))).otherwise(cut)


#: The forms of medications and results that several values are taken from.
DOSE = r"^([A-Z][A-Za-z0-9/\- ]+?)\s+(\d+(?:\.\d+)?)\s*(mcg|mg|g|units?|mL)\s*(PO|IV|IM|SC|SQ|SL|PR|NG|PEG)?\s*(.*)$"
SCALE, DRIP = r"^([A-Za-z][A-Za-z0-9\- ]+?)\s+sliding scale\s+(ordered|started|initiated)", r"^([A-Z][A-Za-z0-9/\- ]+?)\s+drip\s+(initiated|started)"
RESULT = r"^([A-Za-z0-9][A-Za-z0-9 .%/+\-]*?)(?:\s+trending\s+(up|down))?:\s*(<)?(\d+(?:\.\d+)?)\s*([A-Za-z%/0-9.]+)?(?:\s*\[([A-Z]+)\])?"


def _medication(low: Column) -> tuple[Column, Column, Column]:
    return low.contains("reconciliation started"), low.contains("discharge medications reconciled"), low.contains("sliding scale")


def main_form(kind: Column, summary: Column, low: Column) -> Column:
    """The pieces of ``RESULT`` of a result and of ``DOSE`` of a medication; null for others."""
    started, gone, scaled = _medication(low)
    return F.when((kind == "lab_result") & ~low.contains("critical value"), _pieces(summary, RESULT, 6)).when((kind == "medication_event") & ~started & ~gone & ~scaled, _pieces(summary, DOSE, 5))


def other_form(kind: Column, summary: Column, low: Column, main: Column) -> Column:
    """The pieces of ``SCALE`` of a medication by sliding scale and of ``DRIP`` of one that has no dose; null for others."""
    started, gone, scaled = _medication(low)
    return F.when(kind != "medication_event", F.lit(None)).when(scaled, _pieces(summary, SCALE, 2)).when(~started & ~gone & (F.size(main) <= 1), _pieces(summary, DRIP, 2))


def payload(kind: Column, message: Column, fields: Column, level: Column, vitals: Column, m: Column, summary: Column, low: Column, main: Column, other: Column) -> Column:
    """What an event says, as a map of text values whose keys depend on its type. Absent values have no key.

    ``vitals``: the snapshot; ``m`` and ``low``: the message and the ``summary`` in small letters; ``main`` and ``other``: their forms.
    """
    f = lambda k: F.element_at(fields, k)
    like = lambda words: F.get(F.map_values(F.map_filter(fields, lambda k, _: k.rlike(words))), F.lit(0))
    tests = F.flatten(F.transform(F.filter(F.split(message, r"\|"), lambda s: ~s.contains(":") & s.contains(",")), lambda s: F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")))
    rate = r"(\d+(?:\.\d+)?)\s*(units?/kg/hr|units?/hr|mg/hr|mcg/kg/min)"
    of = lambda pieces, g: F.nullif(F.trim(F.get(pieces, F.lit(g))), F.lit(""))
    tail = F.lower(F.coalesce(of(main, 5), F.lit("")))
    started, gone, scaled = _medication(low)
    dosed, dripped = F.size(main) > 1, ~scaled & (F.size(other) > 1)
    action = (
        F.when(started, "reconciliation_started").when(gone, "discharge_reconciliation").when(scaled, F.coalesce(F.lower(of(other, 2)), F.lit("documented")))
        .when(dosed & tail.contains("loading dose"), "loading_dose").when(dosed & tail.contains("administered"), "administered").when(dosed & tail.contains("ordered"), "ordered").when(dosed & tail.contains("initiated"), "initiated")
        .when(dripped, F.lower(of(other, 2))).otherwise("documented")
    )
    medication = {
        "action": action, "medication_count": F.when(gone, _part(low, r"(\d+)\s+medications?")),
        "medication_name": F.when(scaled, of(other, 1)).when(dosed, of(main, 1)).when(dripped, of(other, 1)),
        "regimen": F.when(scaled & (F.size(other) > 1), "sliding_scale"), "monitoring_frequency": F.when(scaled, frequency(_part(message, r"glucose monitoring\s+([A-Za-z0-9]+)"))),
        "dose": F.when(dosed, of(main, 2)), "dose_unit": F.when(dosed, of(main, 3)),
        "route": F.when(dosed, route(of(main, 4))).when(dripped, "intravenous"), "administration_mode": F.when(dripped, "continuous_infusion"),
        "infusion_rate": F.when(dripped, _part(message, rate)), "infusion_rate_unit": F.when(dripped, _part(message, rate, 2)), "weight_kg": F.when(dripped, _part(message, r"Weight:\s*(\d+(?:\.\d+)?)\s*kg")),
    }
    alarm = low.contains("critical value")
    lab = {
        "criticality": F.when(alarm | (F.upper(level) == "ALERT"), "critical"), "status": F.when(alarm, "alerted"),
        "test_name": F.when(alarm, _part(summary, r"critical value\s*-\s*(.+?)(?:\s+elevated|\s+low|$)")).otherwise(of(main, 1)),
        "value": of(main, 4), "comparator": F.when(of(main, 3).isNotNull(), "less_than"), "unit": of(main, 5), "abnormal_flag": of(main, 6), "trend": of(main, 2),
        "reference_range": F.when(~alarm, f("reference")), "previous_value": F.when(~alarm, f("previous")),
    }
    priority = lambda x: F.when(x.contains("stat"), "stat").otherwise("routine")
    order = {"order_set": summary, "priority": priority(low), "ordered_tests": F.nullif(F.array_join(tests, ", "), F.lit("")), "ordering_provider": f("provider")}
    image_order = {"modality": _part(summary, r"^([A-Za-z0-9\-\s]+?)\s+(?:order|requested|placed)"), "priority": priority(m), "indication": F.coalesce(f("reason"), f("indication"))}
    image_result = {"modality": _part(summary, r"^([A-Za-z0-9\-\s]+?)\s+(?:result|resulted|completed)"), "findings": f("findings"), "impression": _part(message, r"(?:impression:?|findings:?|result:)\s*(.+?)(?:\||$)")}
    consult = {
        "specialty": _part(summary, r"^([A-Za-z\s\-]+?)\s+consult\s+(?:requested|accepted)"), "status": F.when(low.contains("requested"), "requested").otherwise("accepted"), "reason": f("reason"),
        "requesting_provider": f("requesting_provider"), "consulting_provider": F.coalesce(f("consulting_provider"), f("provider")), "plan": _part(message, r"plan:?\s*(.+?)(?:\||$)"),
    }
    vital = lambda name: F.nullif(F.element_at(vitals, name), F.lit(""))
    orientation = _part(message, r"(?:alert|oriented|a&o|aao)[\s,]*(?:x)?(\d)")
    nursing = {
        "event_subtype": F.when(low.contains("assessment"), "assessment").when(low.rlike("monitoring|observation"), "monitoring"), "mental_status": F.concat(F.lit("alert_oriented_x"), orientation),
        "pain_level": _part(message, r"pain\s+(\d{1,2})/10"), "diet": like("diet"), "oxygen_support": like("o2|oxygen"),
        "bp": vital("blood_pressure"), **{n: vital(n) for n in MEASUREMENTS if n != "blood_pressure"},
    }
    doing = r"^([A-Za-z0-9\s\-.]+?)\s+(started|completed|began|initiated)"
    state = F.when(summary.rlike(f"(?i){doing}"), F.when(low.rlike("started|begun|initiated"), "in_progress").otherwise("completed"))
    codes = lambda c: F.nullif(F.array_join(F.regexp_extract_all(message, F.lit(rf"(?i){c}[:\s]*(\d+\.?\d*)"), F.lit(1)), ", "), F.lit(""))
    procedure = {
        "procedure_name": _part(summary, doing), "status": state, "provider": f("provider"), "location": F.coalesce(f("location"), f("room")),
        "findings": F.when(state == "completed", _part(message, r"(?:findings?|result):\s*(.+?)(?:\||$)")), "technique": _part(message, r"(?:technique|approach):\s*(.+?)(?:\||$)"),
        "icd_codes": codes("ICD"), "cpt_codes": codes("CPT"), "snomed_codes": codes("SNOMED"),
    }
    status = F.coalesce(*[F.when(m.contains(w), w) for w in STATES])
    after = {"event_name": summary, "patient_status": status, "hemostasis": like("hemostasis|bleeding"), "drain_output": like("drain|output"), "monitoring_plan": like("monitoring|observation")}

    def entries(d: dict[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in d.items()])

    by_kind = {"medication_event": medication, "lab_result": lab, "lab_order": order, "imaging_order": image_order, "imaging_result": image_result, "consult": consult, "nursing_note": nursing, "procedure_event": procedure, "post_procedure": after}
    chosen = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    for k, d in by_kind.items():
        chosen = F.when(kind == k, entries(d)).otherwise(chosen)
    return F.map_from_entries(F.filter(chosen, lambda e: e["value"].isNotNull()))


def _rules() -> Column:
    """``RULES`` as a map: names of required and of all fields, weights."""
    words = lambda names: F.array(*map(F.lit, names))
    rules = [(F.lit(k), F.struct(words(required).alias("required"), words([*required, *optional]).alias("all"), F.array(*map(F.lit, w)).alias("weights"))) for k, (required, optional, w) in RULES.items()]
    return F.create_map(*[x for pair in rules for x in pair])


def with_confidence(e: DataFrame) -> DataFrame:
    """``e`` with confidence_components, struct(required, completeness, extraction, overall, review_needed), null without a payload; normalization_confidence, review_needed and review_status are taken from it."""
    kind, found, source = F.col("event_type"), F.col("normalized_payload"), F.col("source")
    names = unused(e.columns, "_rule", "_known", "_required", "_complete", "_extraction", "_overall")
    rule, known, required, complete, extraction, overall = map(F.col, names)
    share = lambda of: 100.0 * F.size(F.array_intersect(known, of)) / F.size(of)
    e = e.withColumns({names[0]: F.element_at(_rules(), kind), names[1]: F.map_keys(F.map_filter(found, lambda _, v: ~v.isin("", "0"))), names[4]: F.least(F.lit(100), 75 + F.when(source.isNotNull() & (source != "unknown"), 15).otherwise(0) + F.when(F.size("fields") > 0, 10).otherwise(0))})
    e = e.withColumns({names[2]: share(rule["required"]), names[3]: share(rule["all"])})
    w = rule["weights"]
    e = e.withColumn(names[5], F.when(F.size(found) > 0, F.round(F.least(F.lit(100.0), required * w[0] + complete * w[1] + extraction * w[2]), 1)))
    low = overall < F.when(kind.isin(*STRICT), 75).otherwise(70)
    parts = F.struct(F.round(required, 1).alias("required"), F.round(complete, 1).alias("completeness"), extraction.alias("extraction"), overall.alias("overall"), low.alias("review_needed"))
    return e.withColumns({"confidence_components": F.when(F.size(found) > 0, parts), "normalization_confidence": overall, "review_needed": low, "review_status": F.when(low, "pending_review").when(overall.isNotNull(), "approved")}).drop(*names)


def parse_confidence(timestamp: Column, level: Column, source: Column, kind: Column, fields: Column, vitals: Column, found: Column) -> Column:
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = 0.35 + add(timestamp.isNotNull(), 0.2) + add(level != "RAW", 0.1) + add(source != "unknown", 0.1) + add(kind != "log_event", 0.1)
    score = score + F.least(F.lit(0.1), F.size(fields) * 0.02) + F.least(F.lit(0.15), F.size(vitals) * 0.05) + F.least(F.lit(0.1), F.size(found) * 0.02)
    return F.round(F.least(score, F.lit(0.99)), 2)


def normalise_logs(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Typed events of log texts: the entry with event_type, summary, fields, clinical_snapshot, normalized_payload, codes and confidence. Rows only split, nothing is shuffled."""
    return normalise_entries(parse_entries(df, key, text))


def normalise_entries(e: DataFrame) -> DataFrame:
    """The columns of ``normalise_logs`` for parsed entries; works on a stream as well."""
    m, source, kind = F.col("message"), F.col("source"), F.col("event_type")
    # What several expressions read is a column of its own for a while, so that it is worked out once a row.
    names = unused(e.columns, "_large", "_small", "_low", "_level", "_first", "_said", "_main", "_other")
    large, small, low, level, first, said, main, other = map(F.col, names)
    e = e.withColumns(dict(zip(names, [F.upper("source"), F.lower("source"), F.lower("message"), F.upper("level"), F.trim(F.substring_index(m, "|", 1))])))
    e = e.withColumns({"timestamp_iso": iso_timestamp(F.col("timestamp")), "event_type": event_type(source, large, small, low, level), "fields": inline_fields(m), "clinical_snapshot": snapshot(m, low), names[5]: F.lower(first)})
    e = e.withColumns({"summary": F.when(F.col("level") == "RAW", F.substring(m, 1, 120)).otherwise(first), names[6]: main_form(kind, first, said)}).withColumn(names[7], other_form(kind, first, said, main))
    e = e.withColumn("normalized_payload", payload(kind, m, F.col("fields"), F.col("level"), F.col("clinical_snapshot"), low, first, said, main, other)).drop(*names)
    unique = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(m, F.lit(p), F.lit(0))))
    e = e.withColumns({"icd10": unique(ICD10), "cpt": unique(r"\b\d{5}\b"), "parse_confidence": parse_confidence(F.col("timestamp"), F.col("level"), F.col("source"), F.col("event_type"), F.col("fields"), F.col("clinical_snapshot"), F.col("normalized_payload"))})
    return with_confidence(e)


def log_quality(events: DataFrame, key: str) -> DataFrame:
    """(key, structured, normalised, avg_confidence, log_structure, clinical_coverage, overall, grade) of each text of events, from the events alone; ``documents.quality_report`` judges documents with all four scores."""
    structured = F.col("event_type") != "raw_log_line"
    typed = structured & (F.size("normalized_payload") > 0)
    g = events.groupBy(key).agg(F.count_if(structured).alias("structured"), F.count_if(typed).alias("normalised"), F.avg(F.when(structured, F.col("parse_confidence"))).alias("avg_confidence"), F.count_if(typed & F.col("event_type").isin("lab_result", "medication_event", "vitals_capture")).alias("_signals"), F.sum(F.size("clinical_snapshot")).alias("_values"))
    g = g.withColumn("log_structure", F.bround(F.least(F.lit(100.0), F.coalesce("avg_confidence", F.lit(0.0)) * 70 + F.col("normalised") / F.greatest(F.lit(1), F.col("structured")) * 30)))
    g = g.withColumn("clinical_coverage", F.least(F.lit(100.0), 35.0 + 6 * (F.col("_signals") + F.col("_values"))))
    g = g.withColumn("overall", F.bround((F.col("log_structure") + F.col("clinical_coverage")) / 2))
    return g.withColumn("grade", F.when(F.col("overall") >= 90, "A").when(F.col("overall") >= 80, "B").when(F.col("overall") >= 70, "C").otherwise("D")).drop("_signals", "_values")
