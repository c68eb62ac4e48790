"""Column statistics in one aggregate job. What reaches the driver is a row of numbers for each column."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from clearbrook.functions.dates import parse_date
from clearbrook.functions.text import number_of
from clearbrook.sources.staging import staged

#: Name parts and suffixes that roles depend on.
DATE_WORDS = ["date", "time", "update", "created", "dob", "admission", "discharge"]
ENGINEERED = ["_encoded", "_binned", "_length", "_word_count", "_was_missing"]
#: Number of distinct values up to which it is exact; above, it is an estimate (no rule asks for more than 50).
EXACT_DISTINCT = 100
#: Share of the rows by which a first bracket around a quantile is widened on either side, and distinct values that are ranked one by one.
MARGIN, RANKED = 4e-4, 20_000


@dataclass
class ColumnStats:
    name: str
    kind: str
    rows: int
    nulls: int
    distinct: int | None = None
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    skew: float | None = None
    number_rate: float | None = None
    date_rate: float | None = None
    positive: float | None = None  # share of values of 0 or more

    @property
    def missing(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    def bounds(self, k: float) -> tuple[float, float] | None:
        """q1 - k iqr and q3 + k iqr; None without values or spread."""
        if self.q1 is None or self.q3 is None or self.q3 - self.q1 <= 0:
            return None
        return self.q1 - k * (self.q3 - self.q1), self.q3 + k * (self.q3 - self.q1)


def kind_of(df: DataFrame, name: str) -> str:
    t = df.schema[name].dataType
    return "number" if isinstance(t, NumericType) else "date" if isinstance(t, (DateType, TimestampType, TimestampNTZType)) else "string" if isinstance(t, StringType) else "other"


def number(name: str) -> Column:
    """A column in which NaN is missing."""
    x = F.col(f"`{name}`")
    return F.when(~F.isnan(x.cast("double")), x)


def missing(df: DataFrame, name: str) -> Column:
    """Whether a value is null, or NaN in a column of numbers."""
    x = F.col(f"`{name}`")
    return x.isNull() | F.isnan(x) if df.schema[name].dataType.typeName() in ("double", "float") else x.isNull()


def exact_quantiles(df: DataFrame, values: list[Column], probs: list[float]) -> list[list[float | None]]:
    """Exact quantiles (linear between neighbours) of number expressions; None without values. Nulls are left out.

    No task holds a column. Each quantile has a bracket of values, which approximate percentiles narrow pass by pass
    until the bracket holds few distinct ones; only these are counted one by one. A bracket is checked by counts, so
    the result is exact whatever the approximation.
    """
    if not values:
        return []
    table = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    ends = [max(0.0, p - MARGIN) for p in probs] + [min(1.0, p + MARGIN) for p in probs]
    first = table.agg(*[a for i in range(len(values)) for a in (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", ends, 10_000).alias(f"q{i}"))]).first()
    out: list[list[float | None]] = [[None] * len(probs) for _ in values]
    brackets: dict[tuple[int, int], list] = {}
    for i in range(len(values)):
        for j, p in enumerate(probs):
            if n := first[f"n{i}"]:
                brackets[i, j] = [p * (n - 1), first[f"q{i}"][j], first[f"q{i}"][len(probs) + j]]
    margin = MARGIN
    while brackets:  # the widest margin is far beyond the approximation's error, and still narrows a bracket
        inside = {(i, j): F.when(F.col(f"v{i}").between(lo, hi), F.col(f"v{i}")) for (i, j), (_, lo, hi) in brackets.items()}
        sums = [a for (i, j), x in inside.items() for a in (F.count_if(F.col(f"v{i}") < brackets[i, j][1]).alias(f"b{i}_{j}"), F.count(x).alias(f"w{i}_{j}"), F.approx_count_distinct(x).alias(f"d{i}_{j}"))]
        counts, ready, again = table.agg(*sums).first(), {}, {}
        for (i, j), (k, lo, hi) in brackets.items():
            below, within, distinct = (counts[f"{c}{i}_{j}"] for c in "bwd")
            if math.floor(k) < below or math.ceil(k) >= below + within:
                again[i, j] = [k, -math.inf, math.inf]  # the approximation was off: from all values once more, with a wider margin
                margin = min(1 / 64, margin * 16)
            elif lo == hi:
                out[i][j] = lo
            elif distinct <= RANKED:
                ready[i, j] = k - below
            else:
                again[i, j] = [k, below, within]
        if ready:
            cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), inside[i, j].alias("v")) for i, j in ready])
            rows = table.select(F.explode(cells).alias("c")).select("c.*").where("v is not null").groupBy("i", "j", "v").count().collect()
            found = defaultdict(list)
            for r in rows:
                found[r["i"], r["j"]].append((r["v"], r["count"]))
            for (i, j), k in ready.items():
                low, high, at = math.floor(k), math.ceil(k), 0
                picked = {}
                for v, n in sorted(found[i, j]):
                    picked |= {x: v for x in (low, high) if at <= x < at + n}
                    at += n
                out[i][j] = picked[low] if low == high or picked[low] == picked[high] else (high - k) * picked[low] + (k - low) * picked[high]
        if again:
            narrow = {(i, j): (x[1], x[2]) for (i, j), x in again.items() if x[1] != -math.inf}
            ranges = {(i, j): [max(0.0, (math.floor(again[i, j][0]) - b) / w - margin), min(1.0, (math.ceil(again[i, j][0]) - b) / w + margin)] for (i, j), (b, w) in narrow.items()}
            q = table.agg(*[F.percentile_approx(inside[x], r, 10_000).alias(f"q{x[0]}_{x[1]}") for x, r in ranges.items()]).first() if ranges else {}
            for i, j in narrow:
                again[i, j] = [again[i, j][0], *q[f"q{i}_{j}"]]
        brackets = again
    return out


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value of each column, of equal ones the smallest; none for columns without values. Values are counted by a grouped aggregate for each column."""
    out = {}
    for c in columns:
        x = F.col(f"`{c}`")
        top = df.select(x.alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(1).collect()
        out |= {c: top[0]["v"]} if top else {}
    return out


def _aggregates(df: DataFrame, columns: list[str], distinct: bool, rates: bool) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x, kind = F.col(f"`{c}`"), kind_of(df, c)
        if kind == "number":
            x = number(c)
        aggs.append(F.count(x).alias(f"n{i}"))
        if distinct and kind != "other":
            aggs.append(F.approx_count_distinct(x).alias(f"d{i}"))
        if kind == "number":
            v = x.cast("double")
            aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.skewness(v).alias(f"skew{i}"), F.avg((v >= 0).cast("double")).alias(f"pos{i}")]
        if rates and kind == "string":
            aggs += [F.avg(F.when(x.isNotNull(), number_of(x).isNotNull().cast("double"))).alias(f"num{i}"), F.avg(F.when(x.isNotNull(), parse_date(x).isNotNull().cast("double"))).alias(f"date{i}")]
    return aggs


def _with_few(df: DataFrame, columns: list[str], r: dict) -> dict:
    """``r`` with exact numbers of distinct values where they are few."""
    few = [i for i in range(len(columns)) if f"d{i}" in r and r[f"d{i}"] <= 1.5 * EXACT_DISTINCT]
    own = lambda c: number(c) if kind_of(df, c) == "number" else F.col(f"`{c}`")
    return r | (df.agg(*[F.size(F.collect_set(own(c))).alias(f"d{i}") for i, c in enumerate(columns) if i in few]).first().asDict() if few else {})


def _as_stats(df: DataFrame, columns: list[str], r: dict) -> dict[str, ColumnStats]:
    out = {}
    for i, c in enumerate(columns):
        q = r.get(f"q{i}") or [None] * 3
        n, skew = r[f"n{i}"], r.get(f"skew{i}")
        adjusted = skew * (n * (n - 1)) ** 0.5 / (n - 2) if skew is not None and skew == skew and n > 2 else None
        out[c] = ColumnStats(c, kind_of(df, c), r["rows"], r["rows"] - n, r.get(f"d{i}"), r.get(f"mean{i}"), r.get(f"std{i}"), r.get(f"low{i}"), r.get(f"high{i}"), *q, adjusted, r.get(f"num{i}"), r.get(f"date{i}"), r.get(f"pos{i}"))
    return out


def column_stats(df: DataFrame, columns: list[str] | None = None, distinct: bool = False, rates: bool = False, quantiles: bool = True) -> dict[str, ColumnStats]:
    """Statistics of ``columns`` (all if None) from one pass, quantiles from a few more. ``distinct`` is exact up to ``EXACT_DISTINCT``; ``rates`` are the shares of strings that parse."""
    columns = df.columns if columns is None else columns
    r = _with_few(df, columns, df.agg(*_aggregates(df, columns, distinct, rates)).first().asDict())
    if quantiles:
        nums = [i for i, c in enumerate(columns) if kind_of(df, c) == "number"]
        r |= {f"q{i}": q for i, q in zip(nums, exact_quantiles(df, [number(columns[i]).cast("double") for i in nums], [0.25, 0.5, 0.75]), strict=True)}
    return _as_stats(df, columns, r)


def staged_with_stats(df: DataFrame, name: str) -> tuple[DataFrame, dict[str, ColumnStats]]:
    """``df`` written once, and the statistics that roles depend on, observed on the rows as they are written."""
    seen = Observation()
    table = staged(df.observe(seen, *_aggregates(df, df.columns, True, True)), name)
    return table, _as_stats(table, df.columns, _with_few(table, df.columns, dict(seen.get)))


def classify(df: DataFrame, stats: dict[str, ColumnStats] | None = None) -> dict[str, str]:
    """Role of each column: date, numeric, categorical, text or other; engineered columns have none."""
    stats = column_stats(df, distinct=True, rates=True, quantiles=False) if stats is None else stats
    roles = {}
    for c, s in stats.items():
        if c.endswith(tuple(ENGINEERED)):
            continue
        if s.kind == "date":
            roles[c] = "date"
        elif s.kind == "number":
            whole = not isinstance_float(df, c) and s.nulls == 0
            roles[c] = "categorical" if whole and (s.distinct or 0) < 10 else "numeric"
        elif s.kind == "string":
            named = any(w in c.lower() for w in DATE_WORDS)
            rate = s.date_rate or 0
            roles[c] = "date" if rate > 0.7 or (rate > 0.3 and named) else "categorical" if (s.distinct or 0) < 50 else "text"
        else:
            roles[c] = "other"
    return roles


def isinstance_float(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("double", "float", "decimal")
