"""Dates in mixed formats and what is derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order, month before day.
FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy", "M/d/yyyy H:mm", "M-d-yyyy", "yyyy/M/d", "MMM d yyyy", "d MMM yyyy"]
DOCUMENT_FORMATS = ["yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy"]


def parse_date(x: Column, formats: list[str] | None = None) -> Column:
    """Timestamp of the first format that fits; null for others and for ``Unknown``.

    A format that doesn't fit costs an exception for each row, so it is spared where a text lacks its separators, or two numbers.
    """
    t = F.trim(x)

    def tried(f: str) -> Column:
        parsed, fits = F.try_to_timestamp(t, F.lit(f)), [t.contains(c) for c in "/-:" if c in f]
        if re.search(r"[yMd]\W+[yMd]", re.sub("M{3,}", "", f)):  # names of months aside
            fits.append(t.rlike(r"\p{Nd}\P{Nd}+\p{Nd}"))
        for one in fits:
            parsed = F.when(one, parsed)
        return parsed

    return F.coalesce(*[tried(f) for f in formats or FORMATS])


def date_parts(x: Column, name: str, missing: int | None = -1) -> dict[str, Column]:
    """year, month, day and day_of_week (Monday 0) as int columns named after ``name``; nulls become ``missing``."""
    parts = {"year": F.year(x), "month": F.month(x), "day": F.dayofmonth(x), "day_of_week": F.weekday(x)}
    return {f"{name}_{k}": v if missing is None else F.coalesce(v, F.lit(missing)) for k, v in parts.items()}


def age_years(born: Column, as_of: Column) -> Column:
    return F.floor(F.datediff(as_of, born) / 365)


def iso_timestamp(x: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a ``T``; anything else unchanged."""
    return F.coalesce(F.date_format(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss"), x)


def iso_date(x: Column) -> Column:
    """``yyyy-MM-dd`` of the first document format that fits; anything else unchanged."""
    return F.coalesce(F.date_format(parse_date(x, DOCUMENT_FORMATS), "yyyy-MM-dd"), x)
