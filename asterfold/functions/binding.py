"""A value computed once and used often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column, what: str) -> Column:
    """The value; raises, when the row is read, where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(f"no {what}")))
