"""Types of columns that arrive as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearbrook.functions.dates import parse_date
from clearbrook.functions.text import is_null_word, number_of
from clearbrook.operators.stats import column_stats, kind_of

#: Parts of names that suggest numbers and dates.
NUMBER_WORDS = ["amount", "price", "cost", "bill", "salary", "fee", "rate", "count", "total", "value", "quantity", "qty", "age", "percent"]
TIME_WORDS = ["date", "time", "created", "updated", "joined", "birth", "admission"]


def convert_types(df: DataFrame, least: float = 0.7) -> DataFrame:
    """Words that mean nothing become null; then a string column of which more than ``least`` of all rows parses becomes numbers (first if its name suggests so), timestamps or numbers."""
    strings = [c for c in df.columns if kind_of(df, c) == "string"]
    if not strings:
        return df
    df = df.withColumns({c: F.when(~is_null_word(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in strings})
    stats, new = column_stats(df, strings, rates=True, quantiles=False), {}
    for c, s in stats.items():
        share = 1 - s.missing
        numbers, dates = (s.number_rate or 0) * share > least, (s.date_rate or 0) * share > least
        numeric, timed = any(w in c.lower() for w in NUMBER_WORDS), any(w in c.lower() for w in TIME_WORDS)
        if numeric and numbers:
            new[c] = number_of(F.col(f"`{c}`"))
        elif not numeric and dates:
            new[c] = parse_date(F.col(f"`{c}`"))
        elif not timed and numbers:
            new[c] = number_of(F.col(f"`{c}`"))
    return df.withColumns(new) if new else df


def parse_date_columns(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """String columns with the role date become timestamps, and every date column gets year, month, day and weekday (Monday 0; -1 for none)."""
    from clearbrook.functions.dates import date_parts

    new = {}
    for c in [c for c, r in roles.items() if r == "date"]:
        x = parse_date(F.col(f"`{c}`")) if kind_of(df, c) == "string" else F.col(f"`{c}`")
        new |= date_parts(x, c) | {c: x}
    return df.withColumns(new) if new else df
