"""Small column expressions that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), 0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as set it apart from the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def digest(text: Column) -> Column:
    """The first 16 bytes of the SHA-256 of a text; a null text counts as an empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))
