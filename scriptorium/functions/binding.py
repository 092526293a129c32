"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` mentions it.

    A lambda's variable stands for the value, so expressions built on each other grow by addition, not by multiplication. The
    value is where a fold without steps starts, `use` how it ends: an element of a transformed array has its type worked out
    again for every row, through all that is nested in it, and is copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, lambda x: use(x))


def one_of(c: Column, *values: str) -> Column:
    """c.isin(*values), as equalities: in a lambda, IN leaves its list of values by an exception."""
    return reduce(or_, (c == v for v in values))


def let_sql(name: str, value: str, use: str) -> str:
    """The same in SQL: `use` mentions the value by its name."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, _step) -> {name}, {name} -> {use})"
