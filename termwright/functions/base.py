"""Small building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``: inside lambdas nothing is shared otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal_map(table: Mapping[str, str]) -> Column:
    """A constant map."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def quoted(value) -> str:
    """A value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"
