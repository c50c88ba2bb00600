"""Array idioms shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain column used inside a lambda may be inlined by the optimizer and
    then evaluated once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column | str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def double_literal(values: Iterable[float]) -> Column:
    """A constant array<double> folded once at planning time; repr round-trips exactly."""
    text = ",".join(repr(float(value)) for value in values)
    return F.split(F.lit(text), ",").cast("array<double>")
