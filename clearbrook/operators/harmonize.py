"""Tables of several sources under one schema."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame

from clearbrook.functions.values import TARGET_SCHEMAS

#: Words that tell the domain, and the least likeness of names.
HEALTH_WORDS = ["patient", "diagnosis", "mrn", "icd", "clinical", "hospital"]
LEAST = 0.62


def _key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def suggest_names(columns: list[str], domain: str | None = None) -> list[tuple[str, str, float]]:
    """(column, target, confidence), best first: the target whose alias is most like the column's name, if it is like enough. Works on names only."""
    domain = domain or ("healthcare" if any(w in _key(c) for c in columns for w in HEALTH_WORDS) else "general")
    out = []
    for c in columns:
        scored = [(1.0 if _key(c) == a else SequenceMatcher(None, _key(c), a).ratio(), t) for t, aliases in TARGET_SCHEMAS[domain].items() for a in aliases]
        score, target = max(scored, key=lambda s: s[0])
        if score >= LEAST:
            out.append((c, target, round(score, 2)))
    return sorted(out, key=lambda x: (-x[2], x[0]))


def harmonise(tables: list[DataFrame], domain: str | None = None) -> DataFrame:
    """The tables with their columns renamed to the target schema, one under the other; each target takes the best column only."""
    out = None
    for df in tables:
        names: dict[str, str] = {}
        for column, target, _ in suggest_names(df.columns, domain):
            if target not in names.values() and (target == column or target not in df.columns):
                names[column] = target
        df = df.withColumnsRenamed(names)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
