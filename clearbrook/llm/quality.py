"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule carries the features that it needs. The cascade works a feature out inside the branch of the first rule
that needs it, so a row that is rejected costs nothing further. Rules are ordered by rejection per cost, both
estimated on a sample: what a rule rejects of the rows that the rules before it have left, and what its features
that aren't known yet cost on texts of the sample's size.
"""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearbrook.llm.shared import ascii_words, load, set_aside, staged, unused

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
Rule = tuple[list[str], Callable[[dict[str, Column]], Column]]
#: A rule names the features it needs and says what it rejects, over those features.
BASE_RULES: dict[str, Rule] = {
    "too_short": (["n_words"], lambda f: f["n_words"] < 50),
    "repeats_itself": (["n_words", "n_repeat_words"], lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
}
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": (["n_words", "n_symbols"], lambda f: 2 * f["n_symbols"] > f["n_words"]),
    "word_length": (["n_words", "word_chars"], lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    "repeated_lines": (["n_lines", "n_dup_lines"], lambda f: 10 * f["n_dup_lines"] > 4 * f["n_lines"]),
    "shouting": (["n_letters", "n_upper"], lambda f: (2 * f["n_upper"] > f["n_letters"]) & (f["n_letters"] > 0)),
}
#: Times that each feature of the sample is worked out to learn its cost; the median counts.
TIMED = 3
#: Rows that the sample has on average. Verdicts don't depend on it, only the order of the rules.
SAMPLE_ROWS = 2000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated(w: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more."""
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def twice(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        pairs = lambda o: F.filter(o, lambda x, i: F.coalesce(x["h"] == F.get(o, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(o, i + 1)["h"], F.lit(False)))
        starts = F.sort_array(F.transform(_let(ordered, pairs), lambda x: x["p"]))
        # Windows that overlap share words: each start adds the words up to the next start, three at most.
        new = lambda s: F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3))))
        count = F.aggregate(_let(starts, new), F.lit(0), lambda a, x: a + x)
        # Only a text with some window twice is sorted.
        return F.when(F.size(F.array_distinct(h)) < F.size(h), count).otherwise(0)

    return F.when(F.size(w) < 4, 0).otherwise(_let(windows, twice))


def measure(text: Column, names: list[str]) -> Column:
    """A struct of the features ``names`` of a text, as longs; null and empty texts have 0 of each. Words and lines are split once for all that need them."""
    t = F.coalesce(text, F.lit(""))
    plain = {
        "n_symbols": lambda: F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "word_chars": lambda: F.length(F.translate(t, SPACE, "")),
        "n_letters": lambda: F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        "n_upper": lambda: F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
    }
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    of_lines = {"n_lines": F.size, "n_dup_lines": lambda x: F.size(x) - F.size(F.array_distinct(x))}
    of_words = {"n_words": F.size, "n_repeat_words": _repeated}

    def joined(source: Column, of: dict[str, Callable[[Column], Column]]) -> dict[str, Column]:
        wanted = [n for n in of if n in names]
        if not wanted:
            return {}
        both = _let(source, lambda x: F.struct(*[of[n](x).cast("long").alias(n) for n in wanted]))
        return {n: both[n] for n in wanted}

    found = {n: c().cast("long") for n, c in plain.items() if n in names} | joined(lines, of_lines) | joined(ascii_words(t), of_words)
    return F.struct(*[found[n].alias(n) for n in names])


def with_features(df: DataFrame, text: str = "text", only: list[str] | None = None) -> DataFrame:
    """``df`` with the counts named in ``only`` (all if None) of each whole text; a null or empty text counts 0 for each.

    n_repeat_words: words that lie in a 3-word window which the text holds twice or more, its first place included.
    """
    want = FEATURES if only is None else only
    groups = [[n for n in want if n in g] for g in (["n_words", "n_repeat_words"], ["n_lines", "n_dup_lines"], [n for n in FEATURES if n in ("n_symbols", "word_chars", "n_letters", "n_upper")])]
    df = set_aside(df, FEATURES)
    for g in filter(None, groups):
        (held,) = unused(df, "_g")
        df = df.withColumn(held, measure(F.col(text), g))
        df = df.withColumns({n: F.col(f"{held}.{n}") for n in g}).drop(held)
    return df


def feature_costs(sample: DataFrame, text: str, names: list[str]) -> dict[str, float]:
    """Nanoseconds a row that each feature takes in one task over the sample, a written table: the median of ``TIMED`` runs less that of counting characters. They order rules, no verdict depends on them."""

    def timed(value: Column) -> float:
        runs = []
        for _ in range(TIMED):
            began = time.perf_counter_ns()
            sample.coalesce(1).agg(F.sum(value)).collect()
            runs.append(time.perf_counter_ns() - began)
        return statistics.median(runs)

    rows, least = max(1, sample.count()), timed(F.length(text))
    return {n: max(1.0, (timed(measure(F.col(text), [n])[n]) - least) / rows) for n in names}


def rule_order(df: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None, known: list[str] | None = None, sample_rows: int = SAMPLE_ROWS, costs: dict[str, float] | None = None) -> list[tuple[str, float, float]]:
    """(rule, cost in nanoseconds a row, share that it rejects of the rows left to it), the best rejection per cost first; of equal ones the first by name.

    The sample is drawn by a hash of the whole row, about ``sample_rows`` rows of the table. What features cost is timed on it (`feature_costs`) unless given. Which rules
    reject a row is counted for all combinations of rules in one job. Features in ``known`` cost nothing, nor do those of a rule placed before.
    """
    rules = RULES if rules is None else rules
    rows = df.count()
    sample = df if rows <= sample_rows else df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(rows)) < sample_rows)
    sample = staged(sample.select(F.col(f"`{text}`").alias("text")), "quality-sample")
    names = sorted(rules)
    needs = [f for f in FEATURES if any(f in rules[r][0] for r in names)]
    costs = feature_costs(sample, "text", needs) if costs is None else costs
    judged = with_features(sample, "text", needs)
    hits = [F.coalesce(rules[r][1]({f: F.col(f) for f in rules[r][0]}), F.lit(False)).alias(f"r{i}") for i, r in enumerate(names)]
    counts = judged.select(*hits).groupBy(*[f"r{i}" for i in range(len(names))]).agg(F.count("*").alias("n")).collect()
    have, order = set(known or []), []
    while len(order) < len(names):
        left = sum(r["n"] for r in counts)
        best = None
        for i, name in enumerate(names):
            if name in [o[0] for o in order]:
                continue
            share = sum(r["n"] for r in counts if r[f"r{i}"]) / left if left else 0.0
            cost = 1.0 + sum(costs.get(f, 0) for f in rules[name][0] if f not in have)
            if best is None or (-share / cost, cost, name) < best[0]:
                best = ((-share / cost, cost, name), (name, cost, share), i)
        order.append(best[1])
        have |= set(rules[best[1][0]][0])
        counts = [r for r in counts if not r[f"r{best[2]}"]]
    return order


def cascade(order: list[str], text: Column, rules: dict[str, Rule] | None = None, known: dict[str, Column] | None = None) -> Column:
    """The first rule of ``order`` that rejects the text, else null. Features in ``known`` are columns; each other one is worked out in the branch of the first rule that needs it, which a row rejected before doesn't reach."""
    rules = RULES if rules is None else rules

    def branch(i: int, have: dict[str, Column]) -> Column:
        if i == len(order):
            return F.lit(None).cast("string")
        needs, rejects = rules[order[i]]
        new = [n for n in needs if n not in have]
        judged = lambda f: F.when(F.coalesce(rejects(f), F.lit(False)), F.lit(order[i])).otherwise(branch(i + 1, f))
        return judged(have) if not new else _let(measure(text, new), lambda s: judged(have | {n: s[n] for n in new}))

    return branch(0, known or {})


def judge_quality(df: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None, order: list[str] | None = None, features: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """``df``, but for the columns ``without``, with those named in ``features`` (none by default), ``rejected_by`` (null if none) and ``kept``.

    ``order`` of the rules is estimated on a sample unless given; ``kept`` is the same for any order. Null and empty
    texts have no words and fail ``too_short``; very long texts are read whole; repeated rows are judged alike; an empty table gives
    an empty one. Input columns named like an output stay as ``<name>_in``. The result is a written table: a filter on it works nothing out again.
    """
    rules, features = RULES if rules is None else rules, features or []
    order = [m[0] for m in rule_order(df, text, rules, features)] if order is None else order
    df = set_aside(df, ["rejected_by", "kept", *[n for n in FEATURES if n in features]])
    text = text if text in df.columns else f"{text}_in"
    df = with_features(df, text, features) if features else df
    judged = df.withColumn("rejected_by", cascade(order, F.col(text), rules, {f: F.col(f) for f in features})).withColumn("kept", F.col("rejected_by").isNull())
    return staged(judged.drop(*(without or [])), "judged")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge_quality(load(spark, sf_dir, "documents").select("doc_id", "text"), features=counts, without=["text"])
    failed = F.lit(False)
    for needs, rejects in BASE_RULES.values():
        failed = failed | rejects({n: F.col(n) for n in needs})
    return judged.select("doc_id", *counts, failed.alias("base_failed"), "kept")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
u AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS p, len(ws) AS n FROM w),
g AS (SELECT r, p, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, n FROM u WINDOW o AS (PARTITION BY r ORDER BY p)),
c AS (SELECT r, p, count(*) OVER (PARTITION BY r, word, w2, w3) AS k FROM g WHERE p + 2 < n),
hit AS (SELECT DISTINCT r, p + x.i AS p FROM c, (SELECT unnest([0, 1, 2]) AS i) x WHERE k > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM hit GROUP BY r),
f AS (SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
v AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_dup_lines > 4 * n_lines OR (2 * n_upper > n_letters AND n_letters > 0)) AS kept
FROM v
"""
