"""Names of columns that operators add for a while or set aside, and columns that are worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with ``_`` in front until none of ``columns`` has them, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns of ``df`` that an operator's outputs ``names`` would replace are kept as ``<name>_in`` (``_in_in`` and so on if that is taken)."""
    wanted, taken, renamed = {n.lower() for n in names}, {c.lower() for c in [*df.columns, *names]}, {}
    for c in df.columns:
        if c.lower() in wanted:
            new = f"{c}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            renamed[c] = new
    return df.withColumnsRenamed(renamed) if renamed else df


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df.withColumns(columns)``, each worked out once a row, without a shuffle: what follows reads the values.

    Of columns that are only projected, Spark puts the expression in the place of a name; inside a lambda it is then
    worked out again for every element. Nothing is put through the one row that each row generates here.
    """
    held = unused(df.columns, *[f"_w{i}" for i in range(len(columns))])
    row = F.struct(*[c.alias(h) for c, h in zip(columns.values(), held, strict=True)])
    return df.select("*", F.inline(F.array(row))).withColumns(dict(zip(columns, map(F.col, held), strict=True))).drop(*held)
